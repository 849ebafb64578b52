import duckdb
import pytest

TEXTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """``docs([(doc_id, text), ...])`` as a table of documents; more columns may follow in a row."""

    def build(rows, **extra):
        full = [(*r, *("en", "src1", len(r[1] or ""))[len(r) - 2 :]) for r in rows]
        df = spark.createDataFrame(full, TEXTS)
        for name, value in extra.items():
            df = df.withColumn(name, value)
        return df

    return build


@pytest.fixture
def in_sql():
    """Rows of a query over pandas frames registered by name."""

    def run(sql, **frames):
        con = duckdb.connect()
        for name, frame in frames.items():
            con.register(name, frame)
        return con.execute(sql).fetchall()

    return run
