import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text[, lang[, source]]), with columns whose names clash with what operators make."""

    def build(rows, extra=False):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if extra:
            for c in ("row", "key", "kept", "size", "found", "part", "label", "kinds", "home", "score", "n"):
                df = df.selectExpr("*", f"'x' AS {c}")
        return df

    return build


@pytest.fixture(scope="session")
def odd(make):
    """Nulls everywhere, empty, blank, very long and repeated texts, repeated rows, clashing columns."""
    long = " ".join(f"w{i % 997}x{i}" for i in range(30_000))
    rows = [(1, None, None, None), (2, ""), (3, " \n\t"), (4, long), (5, long), (6, "one"), (6, "one"), (None, "Null id. It is here.", None, None), (7, "tie"), (8, "tie"), (9, "ünïcödé ß 漢字 " * 40, "de", "t")]
    return make(rows, extra=True)
