import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


@pytest.fixture()
def docs(spark):
    """docs([(doc_id, text), ...]) -> DataFrame"""
    def make(rows, partitions=3):
        return spark.createDataFrame(rows, DOCS).repartition(partitions) if rows else spark.createDataFrame([], DOCS)
    return make


@pytest.fixture()
def table(spark):
    def make(name, sf=SF):
        return spark.read.parquet(f"{sf}/{name}.parquet")
    return make


@pytest.fixture()
def as_dicts():
    def make(df):
        return sorted((r.asDict(recursive=True) for r in df.collect()), key=lambda r: str(sorted(r.items(), key=str)))
    return make
