"""Small tables for the corpus operators."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use inside.
CLASHING = ("part", "blob", "name", "size", "at", "start", "n", "group", "h", "key", "rep", "grams", "region", "shard", "code", "pos", "spans", "words", "forks")
WORDS = ["amber", "birch", "cedar", "delta", "ember", "fjord", "grove", "haven", "islet", "jetty", "knoll", "larch", "maple", "night", "ocean", "pearl", "quill", "river", "stone", "tulip", "umber", "vivid", "water", "yield", "zebra"]


def prose(r: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(r.choice(WORDS) + str(r.randrange(vocabulary)) for _ in range(n))


def table(spark, rows, clash: bool = False):
    """Rows (doc_id, text); with ``clash`` there are more columns."""
    df = spark.createDataFrame([(i, t, "en", "web", None if t is None else len(t)) for i, t in rows], SCHEMA)
    if clash:
        for c in CLASHING:
            df = df.selectExpr("*", f"'x' as `{c}`")
    return df


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())
