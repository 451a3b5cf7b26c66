import pytest


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Tables here are small and operators have many steps."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture
def texts(spark):
    """Makes a documents table from (doc_id, text) rows, with extra columns whose names operators use themselves."""

    def make(rows, extra=True):
        if not extra:
            return spark.createDataFrame(rows, "doc_id long, text string")
        return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, h string, n int")

    return make
