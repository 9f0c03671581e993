import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho".split()


def prose(n: int, seed: int) -> str:
    """``n`` words without much repetition."""
    return " ".join(f"{WORDS[(i * 7 + seed) % 17]}{(i * i + seed * 31) % 1009}" for i in range(n))


@pytest.fixture
def docs(spark):
    """Rows of every awkward kind: nulls, empty and long texts, ties, repeated rows."""
    long = prose(30_000, 5)
    shared = prose(80, 77)
    rows = [
        (1, prose(60, 1), "en", "a", 1),
        (2, prose(60, 1), "en", "a", 1),
        (3, "", "en", "a", 0),
        (4, None, None, None, None),
        (5, long, "en", "b", 5),
        (6, prose(70, 2) + "\n" + shared, "de", "b", 7),
        (7, shared + "\n" + prose(70, 3), "de", "c", 7),
        (7, shared + "\n" + prose(70, 3), "de", "c", 7),
        (8, "one two", "en", "c", 2),
        (None, prose(90, 4), "en", "c", 3),
        (9, long + " tail", "en", None, 5),
        (10, " \t\n ", "en", "a", 4),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def write(tmp_path):
    """Write tables as the queries read them and give the folder."""

    def put(**tables):
        for name, frame in tables.items():
            frame.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return put


@pytest.fixture
def clash():
    """``docs`` with extra columns named like the inner ones of the operators."""

    def add(frame):
        from pyspark.sql import functions as F

        names = ("slot", "shard", "size", "u", "fp", "ph", "doc", "start", "a", "b", "words", "row", "value", "spans")
        names += ("n_words", "failed", "group", "least", "target", "odds", "found", "text_hash", "hit")
        names += ("toxic", "l_id", "d_id", "entry", "surrogates", "__surrogates", "__text_key", "own_key", "text_key", "n_entities")
        names += ("__times", "__copy", "copies", "part", "__key_a", "__key_b", "__row", "none", "first", "bucket", "keys", "grams")
        return frame.withColumns({n: F.lit(f"own {n}") for n in names})

    return add
