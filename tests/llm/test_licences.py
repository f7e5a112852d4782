import pytest
from pyspark.sql import Row

from oracle_check import compare, connect
from pixelwarrant.llm import licences
from pixelwarrant.llm.queries import ORACLES, op2_licences


def test_query_agrees_with_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert compare(op2_licences(spark, sf), connect(sf), ORACLES["op2_licences"]) is None


def test_canonical_forms_and_edges(spark):
    mit = licences.MIT.replace("license", "licence").upper().replace("NONINFRINGEMENT", "non-infringement")
    texts = {
        1: "Copyright (c) 2001, 2002 Some Body\nAll rights reserved.\n\n" + mit, 2: "released  under the MIT licence", 3: None, 4: "", 5: " ... ",
        6: "Some prose.\n\n * Licensed under the Apache Licence - Version 2.0\n\nMore prose.", 7: "She was released under the MIT License.", 8: "x" * 200_000,
        9: "Licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0.", 10: "(c) 1999 A",
    }
    docs = spark.createDataFrame([Row(doc_id=i, text=t, licence="old", unit=1, digest="d") for i, t in texts.items()], "doc_id long, text string, licence string, unit int, digest string")
    got = sorted((r.doc_id, r.licence, r.whole) for r in licences.scan(docs).collect())
    assert got == [(1, "MIT", True), (2, "MIT", True), (6, "Apache-2.0", False), (6, "Apache-2.0", False), (9, "CC-BY-NC-4.0", False), (9, "CC-BY-NC-4.0", False)]
    assert licences.scan(docs.union(docs)).count() == 2 * len(got) and licences.scan(docs.limit(0)).count() == 0
    assert licences.scan(docs, ()).count() == 0
    with pytest.raises(ValueError):
        licences.known_digests(spark, (("a", "b"),) * (licences.KNOWN_ROWS + 1))


def test_plan_has_no_python(spark, sf):
    plan = op2_licences(spark, sf)._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas"))


def test_long_units_of_holders_and_punctuation(spark):
    """A licence stays one however many copyright lines, rules and blanks are around it."""
    holders = "".join(f"Copyright (c) {1900 + i % 100} Holder number {i} of many\n" for i in range(400))
    texts = {1: holders + "\n" + licences.MIT, 2: "=" * 9000 + " Released under the MIT License. " + "-" * 9000, 3: "word " * 5000 + licences.MIT}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {(r.doc_id, r.licence) for r in licences.scan(docs).where("whole").collect()} == {(1, "MIT"), (2, "MIT")}
