import pytest

TYPES = {"doc_id": "BIGINT", "text": "STRING", "lang": "STRING", "source": "STRING", "n_chars": "BIGINT"}


@pytest.fixture(scope="session")
def documents(spark):
    """Documents from (doc_id, text) or (doc_id, text, source) rows, with an extra column of a busy name."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), "extra") for r in rows]
        schema = ", ".join(f"{k} {v}" for k, v in TYPES.items()) + ", n BIGINT"
        return spark.createDataFrame([(*r[:5], 7) for r in full], schema)

    return make


@pytest.fixture(scope="session")
def labels(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id BIGINT, quality INT, toxic INT")


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (4, "a"), (None, "no id here"), (5, "x" * 5000), (6, "wörd ñ 日本 \U0001f600 " * 30)]
