"""Whole plans (analysis, evaluation) and the registered queries."""
