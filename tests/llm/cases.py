"""Rows that every operator must get through: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # columns named like ones that operators make
        *[T.StructField(c, T.StringType()) for c in ("score", "kept", "n_words", "key", "_row", "_doc", "_id", "n_removed", "kinds", "listed")],
    ]
)

WORDS = ["of", "the", "tion", "en", "and", "re", "sh", "ing", "ble", "ti", "ou", "an", "ha", "ed", "li", "st"]


def prose(seed: int, n: int, per_line: int = 12) -> str:
    """Invented words; distinct seeds share almost no neighbouring pairs."""
    out, x = [], seed * 7919 + 13
    for i in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(x >> 8) % 16] + WORDS[(x >> 14) % 16] + WORDS[(x >> 20) % 16] + ("\n" if i % per_line == per_line - 1 else ""))
    return " ".join(out).replace("\n ", "\n")


def edited(text: str, every: int) -> str:
    """A near copy: every so-many-th word another one."""
    words = text.split(" ")
    return " ".join(f"{w}x" if i % every == every - 1 else w for i, w in enumerate(words))


def rows() -> list[tuple]:
    base, passage = prose(1, 300), prose(2, 80, 1000)
    texts = [
        (1, base), (2, edited(base, 60)), (3, base), (4, None), (5, ""), (6, "   \n \t\n"), (7, "one"), (8, "one two"), (9, "One TWO"),
        (10, "x" * 150_000), (11, prose(3, 20_000)), (12, prose(4, 200) + "\n" + passage), (13, passage + "\n" + prose(5, 150)),
        (14, prose(6, 120)), (14, prose(6, 120)), (15, prose(7, 120)), (15, prose(8, 120)), (None, prose(9, 120)), (None, base), (None, None),
        (16, "spam spam spam " * 60), (17, "É É é " + prose(10, 90)), (18, passage), (19, edited(prose(7, 120), 40)), (20, "a b c " * 30_000),
    ]
    return [(i, t, "en", "s", None if t is None else len(t), *["c"] * 10) for i, t in texts]


def documents(spark, some: list[tuple] | None = None, parts: int = 3):
    return spark.createDataFrame(rows() if some is None else some, SCHEMA).repartition(parts)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, some: list[tuple] = ()):
    return spark.createDataFrame(list(some), "doc_id long, quality int, toxic int")
