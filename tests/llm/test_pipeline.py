"""The pipeline's stages over the smallest tables."""

import pytest

import corpus_pipeline as P
from descmap.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = first = spark.read.parquet(f"{SF}/documents.parquet")
    before = None
    for name, stage in P.STAGES:
        docs = stage(spark, docs, SF).cache()
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert docs.count() == len(ids) and (before is None or ids <= before)
        if name != "bpe":
            assert docs.columns == first.columns
            assert docs.where("n_chars <> length(text)").count() == 0
        before = ids
    assert before and "ids" in docs.columns


def test_extra_columns_and_nulls(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    more = docs.unionByName(spark.createDataFrame([(None, None, None, None, None), (7000, "", "en", "s", 0)], docs.schema))
    names = ("n_words", "keep", "_id", "_hash", "grp", "fp", "hit_spans")
    more = more.selectExpr("*", *[f"cast(null as int) as {n}" for n in names])
    for _, stage in P.STAGES[1:4]:
        more = stage(spark, more, SF)
        assert more.columns[-len(names) :] == list(names)
    assert P.STAGES[4][1](spark, more, SF).count() == more.count() > 0
    assert P.STAGES[2][1](spark, docs.limit(0), SF).count() == 0


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries(spark, name):
    df = queries.queries()[name](spark, SF)
    table, key = ("pages", "page_id") if name.split("_")[0] in ("op2", "op4", "op5") else ("documents", "doc_id")
    assert df.select(key).distinct().count() == df.count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("pages", "labels", "documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = queries.queries()[name](spark, SF), con.sql(queries.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.select(", ".join(got.columns)).fetchall(), key=str)
