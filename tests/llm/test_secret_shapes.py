"""Assigned values that are no secrets stay; those that are go."""

from pyspark.sql import functions as F

from driftwatch.llm import secrets

HEX = "3f786850e387550fdab836ed7e6dc881de23001b"
PLAIN = ["key = \"cache/index_page_1/home\"", "api_key = \"<your-api-key-1>\"", "token: ${TOKEN_1_VALUE}", "secret_key = \"abc1abc1abc1abc1\"", f"commit {HEX[::-1]} of it"]


def test_assigned_values_that_are_no_secrets_stay(spark):
    rows = [(i, f"before\n{t}\nafter") for i, t in enumerate(PLAIN)]
    rows += [(10, f'token = "{HEX}"'), (11, 'password = "sunny-meadow-42"'), (12, 'key = "q8Zt-71xW.pp0"')]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.text for r in secrets.scan(docs).select("doc_id", secrets.redacted(F.col("text"), F.col("findings")).alias("text")).collect()}
    assert {i: out[i] for i, _ in rows if i < 10} == {i: t for i, t in rows if i < 10}
    assert all("[SECRET]" in out[i] for i in (10, 11, 12)), out


def test_features_that_nominate_are_not_judged_by():
    assert not {"key_word", "assigned", "known_format"} & {secrets.FEATURES[i] for i in secrets.JUDGED_BY}
