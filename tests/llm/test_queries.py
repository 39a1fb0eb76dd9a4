"""Contracts of the registered queries: columns, row counts, SQL, empty tables."""

import duckdb
import pytest

from barloom.llm import queries
from tests.test_oracles import TABLES, plain

COLUMNS = {
    "op1": ("documents", {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"}),
    "op2": (None, {"conv_id": "bigint", "n_turns": "bigint", "turns_sha256": "string", "loss_chars": "bigint", "loss_sha256": "string", "formatted_chars": "bigint"}),
    "op3": ("embeddings", {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"}),
    "op4": (None, {"doc_id": "bigint", "item_id": "bigint"}),
    "op5": ("pages", {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"}),
    "op6": ("documents", {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"}),
    "op7": ("documents", {"doc_id": "bigint", "score": "double"}),
    "op8": (None, {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"}),
    "op9": ("documents", {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"}),
    "op10": ("documents", {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}),
    "op11": ("documents", {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}),
    "op12": (None, {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"}),
    "op13": (None, {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"}),
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_contract(spark, sf_dir, name):
    table, wanted = COLUMNS[name.split("_")[0]]
    got = queries.QUERIES[name](spark, sf_dir)
    kinds = dict(got.dtypes)
    assert {c: kinds.get(c) for c in wanted} == wanted
    if table:
        assert got.count() == spark.read.parquet(f"{sf_dir}/{table}.parquet").count()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    assert plain(queries.QUERIES[name](spark, sf_dir).toPandas()) == plain(con.sql(queries.ORACLES[name]).df())


@pytest.fixture(scope="module")
def empty(spark, sf_dir, tmp_path_factory):
    where = tmp_path_factory.mktemp("empty")
    for t in ("documents", "labels", "pages", "benchmark", "conversations", "embeddings"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").limit(0).write.parquet(f"{where}/{t}.parquet")
    return str(where)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).count() == (1 if name.startswith("op2_") else 0)
