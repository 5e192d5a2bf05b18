"""What a Python worker holds besides the arrays of learning, and the size of the batches it gets."""

import random
import tracemalloc

import corpus_pipeline
import pyarrow as pa
import sentencepiece
from pyspark.sql import functions as F

from driftwatch.llm import jaccard, pieces
from driftwatch.llm.queries import PIECE_MODEL

LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_a_batch_is_encoded_in_small_slices(spark, monkeypatch):
    rng = random.Random(3)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(3, 9))) for _ in range(20_000)]
    texts = [" ".join(rng.choice(words) for _ in range(600)) for _ in range(1200)] + [None, "", "a▁b  ü", " "]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    docs, caught = spark.createDataFrame([(1, "a")], "doc_id long, text string"), []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: caught.append(f))
    pieces.encoded(docs, pieces.read_model(PIECE_MODEL))
    found, held = [], []
    for out in caught[0](iter([batch.slice(1200)])):  # makes the encoder
        found += out.column("ids").to_pylist()
    tracemalloc.start()
    for out in caught[0](iter([batch])):
        held.append(tracemalloc.get_traced_memory()[1])
        found += out.column("ids").to_pylist()[-4:]
        tracemalloc.reset_peak()
    tracemalloc.stop()
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    assert found[:4] == found[-4:] == [library.encode(t or "") for t in texts[-4:]]
    assert max(held) < 48_000_000


def test_texts_reach_python_in_small_batches(spark, tmp_path, monkeypatch):
    before, seen = spark.conf.get(LIMIT), {}

    def noted(module):
        real = module.kept
        monkeypatch.setattr(module, "kept", lambda df, name: seen.update({name: spark.conf.get(LIMIT)}) or real(df, name))

    noted(corpus_pipeline)
    noted(jaccard)
    rows = spark.range(3).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.lit("one two three four").alias("text"))
    tokens = corpus_pipeline.encoding_stage(spark, rows, str(tmp_path))
    assert sorted(r.n_tokens for r in tokens.collect()) == [4, 4, 4] and tokens.columns == ["doc_id", "source", "n_tokens", "ids"]
    assert {r.component_id for r in jaccard.near_duplicates(rows, 3, 90).collect()} == {0}
    assert all(seen[n] == "4m" for n in ("tokens", "signatures", "prefixes", "links", "links-between"))
    assert spark.conf.get(LIMIT) == before


def test_a_failed_write_puts_the_settings_back(spark):
    before = spark.conf.get(LIMIT)
    try:
        with jaccard.settings(spark, jaccard.SMALL_BATCHES):
            raise ValueError
    except ValueError:
        pass
    assert spark.conf.get(LIMIT) == before
