import numpy as np

DOC = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, "en", "a", 0), (2, "", "en", "a", 0), (None, "no id here at all", "en", None, 17), (3, " \n\t ", None, "b", 4),
    (4, "one two three", "en", "b", 13), (4, "one two three", "en", "b", 13), (5, "ONE two THREE", "en", "c", 13), (6, "x" * 50_000, "en", None, 50_000),
]


def odd(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns with names that operators use inside."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(ODD, DOC).withColumns({c: F.lit(7) for c in ("size", "taken", "c", "label", "n", "key", "k", "h", "_t", "item")})


def words(t):
    return (t or "").translate({i: i + 32 for i in range(65, 91)}).encode().split()


def prose(rng: np.random.Generator, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{i}" for i in rng.zipf(1.3, n) % vocabulary)
