"""From documents to training tokens: quality, near duplicates, secrets, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``docs``, whatever further columns and names these have. ``doc_id``, ``text`` and ``source`` are needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftwatch.llm import jaccard, mixing, pieces, quality, secrets
from driftwatch.llm.queries import PIECE_MODEL, table
from driftwatch.llm.scratch import SMALL_BATCHES, kept, settings

ORACLE_SQL = None  # the vote of the neighbours, the forest and the encoding have no SQL form


def _folded(docs: DataFrame, *needed: str) -> DataFrame:
    """The needed columns, and all others in one column that no operator's names can clash with."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in needed]
    return docs.select(*needed, F.struct(F.lit(0).alias("_"), *rest).alias("_rest"))


def _unfolded(df: DataFrame, columns: list[str], *needed: str) -> DataFrame:
    return df.select(*[F.col(c) if c in needed else F.col("_rest")[c].alias(c) for c in columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the neighbours vote good; empty ones are judged by the share of good labels."""
    folded = _folded(docs, "doc_id", "text")
    judged = quality.classify(folded, table(spark, sf_dir, "labels"))
    return _unfolded(judged.where("predicted = 1"), docs.columns, "doc_id", "text")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least id.

    Of rows that repeat an id one stays. Rows without an id cannot be named in a group and stay.
    """
    folded = _folded(docs, "doc_id", "text")
    found = jaccard.near_duplicates(folded)
    first = kept(found.where(F.col("id") == F.col("component_id")).select(F.col("id").alias("doc_id")).distinct(), "kept-ids")
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")
    named = folded.join(first, "doc_id").withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    return _unfolded(named.unionByName(folded.where("doc_id is null")), docs.columns, "doc_id", "text")


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets replaced; n_chars follows the text."""
    found = secrets.scan(_folded(docs, "doc_id", "text"))
    hit = F.exists("findings", lambda c: c["secret"])
    cut = found.withColumn("text", F.when(hit, secrets.redacted(F.col("text"), F.col("findings"))).otherwise(F.col("text")))
    out = _unfolded(cut, docs.columns, "doc_id", "text")
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target asks."""
    mixed = mixing.mixed_documents(_folded(docs, "doc_id", "text", "source"))
    return _unfolded(mixed, docs.columns, "doc_id", "text", "source")


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, ids) of every row, written here, so that texts go to Python in small batches."""
    tokens = pieces.encoded(docs.select("doc_id", "source", "text"), pieces.read_model(PIECE_MODEL))
    counted = tokens.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")
    with settings(spark, SMALL_BATCHES):
        return kept(counted, "tokens")


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("secret scans", secrets_stage),
    ("mixing sources to target weights", mixing_stage),
    ("SentencePiece encoding and decoding", encoding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        docs = docs if stage is encoding_stage else kept(docs, name.replace(" ", "-"))
    return docs
