import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents of (doc_id, text), with columns whose names operators might use themselves."""

    def of(rows, source="s", extra=False):
        full = [(i, t, "en", source if isinstance(source, str) else source(i), len(t) if t is not None else None) for i, t in rows]
        df = spark.createDataFrame(full, DOCS)
        if extra:
            for c in ("key", "size", "doc", "hits", "pos", "content", "id", "h", "features", "partner", "leader", "epochs"):
                df = df.selectExpr("*", f"'x' as `{c}`")
        return df

    return of


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)
