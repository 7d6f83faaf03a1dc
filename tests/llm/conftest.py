import pytest


@pytest.fixture
def docs(spark):
    """Makes a table of documents with an extra column that clashes with names the operators use."""

    def make(rows, clash="h"):
        schema = f"doc_id long, text string, lang string, source string, n_chars long, {clash} string"
        return spark.createDataFrame([(*r, *[None] * (6 - len(r))) if len(r) < 6 else r for r in rows], schema)

    return make


@pytest.fixture
def saved(spark, tmp_path):
    """Writes tables under the names the queries read."""

    def save(**tables):
        for name, df in tables.items():
            df.write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return save
