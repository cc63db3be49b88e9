"""The registered queries against SQL, and the pipeline stage by stage."""

from collections import Counter

import pytest
from compare import open_tables
from conftest import DATA
from llm_cases import SCHEMA, edge_texts, lower, rows
from test_dedup import component_brute, print_brute

import corpus_pipeline
from eventloom.llm.catalog import LLM_QUERIES
from eventloom.llm.oracle import LLM_ORACLE


@pytest.mark.parametrize("name", LLM_ORACLE)
def test_against_sql(spark, name):
    df = LLM_QUERIES[name](spark, f"{DATA}/sf0.01")
    columns = sorted(df.columns)
    listed = ", ".join(columns)
    sql = open_tables(f"{DATA}/sf0.01").execute(f"SELECT {listed} FROM ({LLM_ORACLE[name]})").fetchall()
    assert Counter(tuple(r) for r in df.select(*columns).collect()) == Counter(sql)


@pytest.mark.parametrize("name", [n for n in LLM_QUERIES if n not in LLM_ORACLE])
def test_whole_table(spark, name):
    got = LLM_QUERIES[name](spark, f"{DATA}/sf0.001")
    table = "pages" if "html" in name else "documents"
    key = got.columns[0]
    assert got.select(key).distinct().count() == spark.read.parquet(f"{DATA}/sf0.001/{table}.parquet").count()


def test_simhash_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("doc_id", "text").collect()
    prints = {r.doc_id: print_brute(r.text) for r in docs}
    roots, least = component_brute(sorted(set(prints.values()))), {}
    for i, p in prints.items():
        least[roots[p]] = min(i, least.get(roots[p], i))
    got = LLM_QUERIES["op7_simhash"](spark, f"{DATA}/sf0.01").collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {
        (i, f"{p:016x}", least[roots[p]]) for i, p in prints.items()}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(edge_texts()), SCHEMA).repartition(3).cache()


def test_stages_take_edges_and_keep_columns(spark, docs):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for df in (docs, docs.where("false")):
            got = stage(spark, df, "")
            assert got.schema.simpleString() == docs.schema.simpleString()
            assert Counter(map(tuple, got.collect())).keys() <= Counter(map(tuple, df.collect())).keys()
    assert corpus_pipeline.pieces(spark, docs.where("false"), "").collect() == []


def test_exact_and_near_stages(spark, docs):
    all_rows = [(r.doc_id, r.text) for r in docs.collect()]
    texts = {lower(t or "") for _, t in all_rows}
    kept = corpus_pipeline.exact(spark, docs, "").collect()
    assert Counter(lower(r.text or "") for r in kept) == Counter(texts)
    for r in kept:
        same = [i for i, t in all_rows if lower(t or "") == lower(r.text or "") and i is not None]
        assert r.doc_id == max(same, default=None)
    once = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    prints = {r.doc_id: print_brute(r.text) for r in once.collect()}
    roots, least = component_brute(sorted(set(prints.values()))), {}
    for i, p in prints.items():
        least[roots[p]] = min(i, least.get(roots[p], i))
    assert sorted(r.doc_id for r in corpus_pipeline.near(spark, once, "").collect()) == sorted(least.values())


def test_pipeline(spark):
    table = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    got = corpus_pipeline.run(spark, f"{DATA}/sf0.01").toPandas()
    assert set(got.doc_id) <= {r.doc_id for r in table.select("doc_id").collect()}
    assert len(set(got.doc_id)) > 0.5 * table.count() and set(got["sample"]) == {1, 2}
