import pytest

from shotlake.plans import catalog
from tests.compare import SF, duckdb_rows, spark_rows


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, name):
    names, rows = spark_rows(catalog.QUERIES[name](spark, SF))
    wanted_names, wanted = duckdb_rows(catalog.ORACLE_SQL[name])
    assert names == wanted_names
    assert rows and rows == wanted


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_fold_gives_the_same_rows_for_any_partitioning(spark, name):
    one = spark_rows(catalog.QUERIES[name](spark, SF))
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert one[1] and spark_rows(catalog.QUERIES[name](spark, SF)) == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
