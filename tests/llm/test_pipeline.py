import random

import corpus_pipeline
from lapsewise.llm.shared import Scratch


def test_stages_take_effect(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    names, scratch = docs.columns, Scratch(spark, "test")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, small), name)
        assert docs.columns == names
        sizes.append(docs.count())
    assert sizes[0] >= sizes[1] > sizes[2] == sizes[3] == sizes[4]
    out = scratch.table(corpus_pipeline.STAGES[-1][1](spark, docs, small), "packing")
    assert out.select("doc_id").distinct().count() == sizes[-1]


def test_repeated_rows_and_rows_without_id(spark):
    """One row of a repeated one stays, with its whole text; rows without doc_id, and others that share a doc_id, stay too."""
    rng = random.Random(11)
    texts = ["".join(rng.choice("abcdefghij klmnop") for _ in range(600)) for _ in range(5)]
    rows = [(1, texts[0]), (1, texts[0]), (2, texts[1]), (None, texts[2]), (None, texts[3]), (None, texts[1]), (3, texts[4]), (3, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept, scratch = docs, Scratch(spark, "test")
    for name, stage in corpus_pipeline.STAGES[1:3]:
        kept = scratch.table(stage(spark, kept, None), name)
    want = [(1, texts[0]), (2, texts[1]), (None, texts[2]), (None, texts[3]), (3, texts[4]), (3, ""), (None, "")]
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted(want, key=str)
    out = scratch.table(corpus_pipeline.STAGES[-1][1](spark, kept, None), "packing").where("piece = 0").collect()
    assert sorted((r["doc_id"] for r in out), key=str) == sorted((d for d, _ in want), key=str)
