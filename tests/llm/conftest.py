import pytest
from pyspark.sql import types as T


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from demandlens.session import local_session

    spark = local_session(8, partitions=4, app="llm-tests")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    return spark


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs_of(spark):
    """Documents from (doc_id, text[, lang, source]), with extra columns whose names the operators use themselves."""

    def make(rows, extra=True):
        rows = [(*r, *[None] * (4 - len(r)), len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(rows, DOCS) if rows else spark.createDataFrame([], T._parse_datatype_string(DOCS))
        if extra:
            for name in ("n", "key", "root", "size", "part", "score", "kept", "h"):
                df = df.selectExpr("*", f"'x' AS {name}")
        return df

    return make
