"""The pipeline's stages, each on its own input, and the whole on the smallest tables."""

import corpus_pipeline
from orrery.llm import queries

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and corpus_pipeline.ORACLE_SQL is None
    decided = {
        0: lambda d: {r.doc_id for r in queries.quality.judged(d, spark.read.parquet(f"{FOLDER}/labels.parquet")).where("kept").collect()},
        1: lambda d: {r.doc_id for r in queries.near_dedup.classes(d).where("kept").collect()},
        2: lambda d: {r.doc_id for r in queries.decontaminate.decontaminate(d, spark.read.parquet(f"{FOLDER}/benchmark.parquet")).where("not contaminated").collect()},
        3: lambda d: {r.doc_id for r in d.collect()},
        4: lambda d: {r.doc_id for r in d.collect()},
    }
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        want = decided[k](docs)
        out = stage(spark, docs, FOLDER)
        if k < 4:
            assert out.columns == docs.columns
        rows = out.collect()
        assert {r.doc_id for r in rows} == want and len(rows) == len(want)
        docs = spark.createDataFrame(rows, out.schema)
    assert 0 < len(rows) < 200
    assert {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, FOLDER).collect()} == {r.doc_id: r.ids_sha256 for r in rows}
