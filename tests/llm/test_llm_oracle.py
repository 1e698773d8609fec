import pytest
from compare import same

from sfumato.llm import queries, sql


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_same_as_sql(spark, data, duck, name):
    same(queries.queries()[name](spark, data), duck.sql(sql.oracle_sql()[name]).df())


def test_every_document_has_ids(spark, data, library):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = {r["doc_id"]: r["ids"] for r in queries.p6_ids(spark, data).collect()}
    assert got == {i: library.encode(t or "", add_special_tokens=False).ids for i, t in docs.items()}


def test_packing_of_documents(spark, data):
    got = queries.p7_packing(spark, data).toPandas()
    used = got.groupby(["size_id", "capacity", "bin"])["size"].sum().reset_index()
    assert (used["size"] <= used["capacity"]).all()
    docs = spark.read.parquet(f"{data}/documents.parquet").count()
    assert (got.groupby("size_id")["doc_id"].nunique() == docs).all()


def test_pairs_look_the_same(spark, data):
    from sfumato.llm.lookalike import skeleton

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in queries.p8_found(spark, data).collect():
        a, b = docs[r["doc_id_a"]], docs[r["doc_id_b"]]
        assert a != b and r["doc_id_a"] < r["doc_id_b"] and skeleton(a).split() == skeleton(b).split()
