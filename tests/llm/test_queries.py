import pytest

from minegrid.llm import queries as Q
from tests.compare import differs

COLUMNS = {
    "p1_found": ["business_id_1", "business_id_2"], "p3_found": ["business_id_1", "business_id_2"], "p4_found": ["time_no"], "p5_found": ["arrival_no"], "p8_ids": ["doc_id", "ids"], "p10_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_equals_sql(spark, sf, name):
    assert differs(spark, sf, Q.QUERIES[name], Q.ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, sf, name):
    assert Q.QUERIES[name](spark, sf).columns == COLUMNS[name]


def test_every_document_has_a_container(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").count()
    out = Q.p9_containers(spark, sf)
    assert out.select("doc_id").distinct().count() == docs and out.groupBy("container").sum("n_tokens").where("`sum(n_tokens)` > 2048").count() == 0
