"""Licence scans by canonical digests, DataFrame functions only.

A text is brought to a canonical form: lower case; equivalent spellings and words made one; copyright lines left out; everything
but letters and digits is a single space. Two texts with equal forms are the same licence text. The units of a document are its
whole text, its paragraphs (between blank lines) and its lines; every unit's digest is looked up among those of the known licence
texts by a hash join. Units with more letters and digits, copyright lines apart, than any known text can have can't match and aren't
hashed.

The known texts are a parameter: (licence, text) pairs, whole licences or the short grants that refer to them. They are a stated
set of at most `KNOWN_ROWS` rows, broadcast once.

Defined cases: a null, empty or form-less unit matches nothing; repeated rows and units count each; an empty table has no
matches; other columns are left alone.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KNOWN_ROWS = 10_000

#: Spellings taken as equal, the first replaced by the second.
EQUIVALENT = (
    ("licence", "license"), ("licenced", "licensed"), ("licences", "licenses"), ("licencing", "licensing"), ("sublicence", "sublicense"), ("organisation", "organization"),
    ("authorisation", "authorization"), ("authorised", "authorized"), ("acknowledgement", "acknowledgment"), ("favour", "favor"), ("favours", "favors"),
    ("honour", "honor"), ("initialise", "initialize"), ("labelled", "labeled"), ("merchantibility", "merchantability"), ("noninfringement", "non infringement"),
    ("whilst", "while"), ("wilful", "willful"), ("fulfil", "fulfill"), ("recognised", "recognized"), ("utilisation", "utilization"), ("analogue", "analog"),
    ("programme", "program"), ("percent", "per cent"), ("copyright owner", "copyright holder"), ("https", "http"),
)

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE
OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR
IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

#: The known texts, whole licences and statements that put a text under one.
KNOWN: tuple[tuple[str, str], ...] = (
    ("MIT", MIT),
    ("MIT", "MIT License\n\n" + MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This work is licensed under the MIT License."),
    ("ISC", ISC),
    ("ISC", "ISC License\n\n" + ISC),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Released under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

#: A line that only names holders and years.
COPYRIGHT = r"(?m)^[\s*#/;-]*(copyright|\(c\)|©|all rights reserved)[^\n]*$"
OTHER = r"[^\p{L}\p{N}]+"
REACH = 4  # times the longest known text; its letters and digits, in whatever spelling, are fewer


def forms(text: Column, of_lines: bool = False) -> Column:
    """The canonical form of a text. One pass finds words, one joins them; spellings are replaced as whole words."""
    lower = F.lower(text)
    bare = lower if of_lines else F.regexp_replace(lower, COPYRIGHT, "")
    out = F.concat(F.lit(" "), F.regexp_replace(bare, OTHER, " "), F.lit(" "))
    for one, other in EQUIVALENT:
        out = F.replace(out, F.lit(f" {one} "), F.lit(f" {other} "))
    return F.trim(out)


def known_digests(spark, known: tuple[tuple[str, str], ...] = KNOWN) -> DataFrame:
    if len(known) > KNOWN_ROWS:
        raise ValueError(f"{len(known)} known texts; the bound is {KNOWN_ROWS}")
    rows = spark.createDataFrame(list(known), "licence string, text string")
    rows = rows.select("licence", F.sha2(forms(F.col("text")), 256).alias("digest"))
    return rows.groupBy("digest").agg(F.min("licence").alias("licence"))


def short(unit: Column, most: int) -> Column:
    """Whether a unit has at most `most` letters and digits outside copyright lines; only long ones are read for it."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(unit), COPYRIGHT, ""), OTHER, "")
    return (F.length(unit) <= most) | (F.length(bare) <= most)


def units(docs: DataFrame, text: str, most: int) -> DataFrame:
    """Every other column, `unit`, and `whole` (the unit is the document's text). A unit equal to the whole text is only it."""
    whole = F.array(F.struct(F.col(text).alias("unit"), F.lit(True).alias("whole")))
    paragraphs, lines = F.split(text, r"\n\s*\n"), F.split(text, "\n")
    inner = F.when(F.size(paragraphs) > 1, F.concat(paragraphs, lines)).when(F.size(lines) > 1, lines).otherwise(F.array().cast("array<string>"))
    parts = F.transform(F.filter(inner, lambda u: short(u, most) & (F.length(u) > 0)), lambda u: F.struct(u.alias("unit"), F.lit(False).alias("whole")))
    all_units = F.concat(F.filter(whole, lambda u: short(u["unit"], most)), parts)
    return docs.where(F.col(text).isNotNull()).withColumn("_u", F.explode(all_units)).drop(text, "unit", "whole").select("*", "_u.unit", "_u.whole").drop("_u")


def scan(docs: DataFrame, known: tuple[tuple[str, str], ...] = KNOWN, text: str = "text") -> DataFrame:
    """One row per unit that is a known text: the document's other columns, `licence` and `whole`."""
    most = REACH * max((len(t) for _, t in known), default=0)
    found = units(docs.drop("licence", "digest"), text, most)
    found = found.withColumn("digest", F.sha2(forms(F.col("unit")), 256)).drop("unit")
    return found.join(F.broadcast(known_digests(docs.sparkSession, known)), "digest").drop("digest")


def oracle() -> str:
    """The query op2 in DuckDB's SQL."""

    def form(text: str) -> str:
        out = f"' ' || regexp_replace(regexp_replace(lower({text}), '(?m)^[\\s*#/;-]*(copyright|\\(c\\)|©|all rights reserved)[^\\n]*$', '', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g') || ' '"
        for one, other in EQUIVALENT:
            out = f"replace({out}, ' {one} ', ' {other} ')"
        return f"trim({out})"

    quoted = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in KNOWN)
    most = REACH * max(len(t) for _, t in KNOWN)
    return f"""
with known as (select sha256({form('t')}) as digest, min(n) as licence from (values {quoted}) as k(n, t) group by 1),
parts as (select doc_id, text, regexp_split_to_array(text, '\\n\\s*\\n') as p, string_split(text, chr(10)) as l from documents where text is not null),
units as (
    select doc_id, text as unit, true as whole from parts
    union all select doc_id, unnest(p), false from parts where len(p) > 1
    union all select doc_id, unnest(l), false from parts where len(l) > 1
)
select doc_id, licence, count(*) as units, bool_or(whole) as whole_text
from (select doc_id, whole, sha256({form('unit')}) as digest from units where length(unit) between 1 and {most}) join known using (digest)
group by doc_id, licence
"""
