import pytest

FIELDS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a table of documents from {id or (id, n): text} or [(id, text)]; extra columns with clashing names included."""

    def make(rows, extra=False):
        rows = list(rows.items()) if isinstance(rows, dict) else list(rows)
        df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], FIELDS)
        if extra:
            for name in ("rid", "line", "h", "label", "id", "a", "band", "score", "rank", "sequence_id", "kept", "row", "words", "spans", "d_", "r_", "dropped_", "new_", "y", "bits", "lx", "salt"):
                df = df.selectExpr("*", f"'x' as {name}")
        return df

    return make


def as_tuples(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
