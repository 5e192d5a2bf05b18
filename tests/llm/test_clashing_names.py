"""Inputs whose columns are named like columns that operators use inside."""

from driftwatch.llm import mixing, warc


def test_archives(spark):
    rows = [(i, f"u{i}", "x" * 1200 if i < 4 else "y", i, "d", -1) for i in range(8)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, _largest long, _digest string, _refers_to long")
    found = {r["row_id"]: (r["record_type"], r["refers_to"]) for r in warc.archived(pages).collect()}
    assert found == {**{i: ("revisit", 3) for i in range(3)}, **{i: ("response", None) for i in range(3, 8)}}


def test_short_and_keyless_rows_spread(spark):
    rows = [(i if i % 2 else None, f"u{i}", None if i % 3 else "short") for i in range(400)]
    marked = warc.with_references(spark.createDataFrame(rows, "key long, uri string, payload string"), "key", "payload")
    assert marked.select("_digest").distinct().count() == 400
    assert marked.where("_refers_to IS NOT NULL").count() == 0


def test_mixing(spark):
    docs = spark.createDataFrame([(1, "a", "one two", "p", 7), (2, "b", "three", "q", 8)], "doc_id long, source string, text string, _source string, _copy int")
    assert {r["_source"] for r in mixing.mix_counts(docs).collect()} == {"p", "q"}
    copies = mixing.mixed_documents(docs)
    assert copies.columns == docs.columns
    assert {(r["_source"], r["_copy"]) for r in copies.collect()} <= {("p", 7), ("q", 8)}
