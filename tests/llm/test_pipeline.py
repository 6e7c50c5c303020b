import inspect

import corpus_pipeline
from groundshift.llm import queries

from .helpers import SF


def test_stages_and_run(spark):
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        assert list(inspect.signature(stage).parameters) == ["spark", "docs", "sf_dir"]
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            counts.append(out.count())
        docs = out.cache()
    assert counts == sorted(counts, reverse=True) and counts[2] == counts[3] > 0
    assert docs.select("doc_id").distinct().count() == counts[3]
    want = sorted(map(tuple, docs.drop("sequence_id").collect()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).drop("sequence_id").collect())) == want


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_registered():
    import __spark_entry__ as entry

    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert {int(k[2:].split("_")[0]) for k in queries.QUERIES} == set(range(1, 14))
