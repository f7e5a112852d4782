"""Readers and writers: image files, archives, feature tables, manifests, reports."""
