import zlib

import corpus_pipeline
from barloom.llm import decontaminate, pii, quality
from barloom.llm.common import crc_fold
from pyspark.sql import functions as F
from tests.llm.test_neardup import brute as groups
from tests.llm.test_decontaminate import brute as overlaps
from tests.llm.test_packing import check


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and corpus_pipeline.ORACLE_SQL is None
    stages = [f for _, f in corpus_pipeline.STAGES]

    good = stages[0](spark, docs, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(crc_fold(F.col("doc_id"), 5) != 0)
    model = quality.fit(docs, labels)
    every = {r.doc_id: r for r in docs.collect()}
    want = {i for (i, r), s in zip(every.items(), quality.scores([r.text for r in every.values()], model)) if s >= 0.3}
    assert {r.doc_id for r in good.collect()} == want and good.columns == docs.columns

    single = stages[1](spark, good, sf_dir)
    rows = [(r.doc_id, r.text) for r in good.collect()]
    want = {i for i, n, low in groups(rows) if i == low}
    assert {r.doc_id for r in single.collect()} == want and single.columns == docs.columns

    clean = stages[2](spark, single, sf_dir)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = want - {x[0] for x in overlaps([(i, every[i].text) for i in want], items)}
    assert {r.doc_id for r in clean.collect()} == want and clean.columns == docs.columns

    masked = stages[3](spark, clean, sf_dir)
    got = {r.doc_id: r for r in masked.collect()}
    assert set(got) == want and masked.columns == docs.columns and masked.dtypes == docs.dtypes
    assert all(r.text == pii.masked(every[i].text) and r.n_chars == len(r.text) for i, r in got.items())

    packed = stages[4](spark, masked, sf_dir).collect()
    check([(r.doc_id, r.text) for r in got.values()], packed, 2048)
    run = corpus_pipeline.run(spark, sf_dir).collect()
    assert {tuple(r) for r in run} == {tuple(r) for r in packed} and len(run) == len(packed)


def test_stages_take_empty_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0, name
