"""The queries over the operators of this subpackage, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwatch.llm import (
    audit,
    jaccard,
    mixing,
    packing,
    periods,
    pieces,
    quality,
    repeats,
    rules,
    secrets,
    topk,
    urls,
    warc,
)

PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
WORD_TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"
PLANTED_EVERY = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archived(table(spark, sf_dir, "pages"))
    return records.select(
        F.col("row_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.classify(
        table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    )
    return judged.select("doc_id", "held_out", "score", "predicted")


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = jaccard.near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=90)
    return linked.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trips(table(spark, sf_dir, "documents"), pieces.read_model(PIECE_MODEL))


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeats.without_repeats(table(spark, sf_dir, "documents"), texts=False)
    return cut.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_counts(table(spark, sf_dir, "documents"))
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return mixed.select("doc_id", "size", "source_size", "target", taken)


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select(
        "page_id", "host", "path", "rule", "verdict"
    )


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.judged(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return judged.select("doc_id", *rules.BASE_COLUMNS, "base_failed", "kept")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    cut = secrets.redacted(F.coalesce("text", F.lit("")), F.col("findings"))
    return found.select(
        "doc_id",
        F.size("findings").cast("long").alias("n_candidates"),
        F.size(F.filter("findings", lambda c: c["secret"])).cast("long").alias("n_secrets"),
        F.sha2(cut, 256).alias("redacted_sha256"),
    )


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(rows, rows.where(F.col("vec_id") % topk.QUERY_EVERY == 0))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces_ = packing.packed(table(spark, sf_dir, "documents"), WORD_TOKENIZER)
    crc = F.crc32("ids").alias("ids_crc32")
    return pieces_.select(F.col("id").alias("doc_id"), "start", "length", crc, "doc_tokens", "sequence_id", "offset")


def op12_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audited(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with a periodic tail in the texts of one document in ten, chosen by its id's CRC."""
    h = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(1))
    hit = h % PLANTED_EVERY == 0
    parts = docs.select("doc_id", "text", h.alias("h"), F.when(hit, F.regexp_extract_all("text", F.lit(audit.WORD), F.lit(0))).alias("words"))
    g, n = F.floor(F.col("h") / PLANTED_EVERY), F.coalesce(F.size("words"), F.lit(0))
    placed = parts.withColumn("n", n).withColumn("a", F.when(n > 0, g % n).cast("int"))
    rest = F.col("n") - F.col("a")
    placed = placed.withColumn("p", (1 + F.floor(rest / (3 + g % 8))).cast("int"))
    times = F.ceil(rest / F.col("p")).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), times)), F.lit(1), rest)
    made = F.concat_ws(" ", F.slice("words", F.lit(1), F.col("a")), tail)
    return placed.select("doc_id", F.when(F.col("n") > 0, made).otherwise(F.col("text")).alias("text"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods.periodic_runs(planted(table(spark, sf_dir, "documents"))).withColumn("best", periods.longest())
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_quality": op2_quality,
    "op3_jaccard": op3_jaccard,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_repeats": op5_repeats,
    "op6_mixing": op6_mixing,
    "op7_urls": op7_urls,
    "op8_rules": op8_rules,
    "op9_secrets": op9_secrets,
    "op10_topk": op10_topk,
    "op11_packing": op11_packing,
    "op12_audit": op12_audit,
    "op13_runs": op13_runs,
}
