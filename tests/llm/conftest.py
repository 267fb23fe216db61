import duckdb
import pytest

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels")


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.fixture(scope="session")
def documents(con):
    return con.execute("SELECT doc_id, text, lang, source FROM documents ORDER BY doc_id").fetchall()


@pytest.fixture
def frame(spark):
    """Rows of (doc_id, text, lang, source, n_chars) plus columns whose names clash with internal ones."""
    schema = ("doc_id long, text string, lang string, source string, n_chars long, _id long, _text string, _set string, "
              "_kept_id long, _mix_n int, _n long, component_id long, keep_id long, size long, lang_pred string, score double")

    def make(rows):
        return spark.createDataFrame(
            [(i, t, lang, src, len(t or ""), 1, "x", "y", 2, 3, 4, 5, 6, 7, "z", 0.5) for i, t, lang, src in rows], schema)
    return make
