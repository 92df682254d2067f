import random

from codewhiff.llm import common, decontaminate, langid, ngram_join, suffix_dedup
from helpers import prose
from test_decontaminate import brute as leaks
from test_ngram_join import expected as near
from test_packing import check as packed
from test_repeats import expected as repeats

import __spark_entry__
import corpus_pipeline as P

NAMES = ["language_id", "near_duplicates", "repeated_passages", "decontamination", "best_fit_packing"]


def test_registered():
    assert [n for n, _ in P.STAGES] == NAMES
    assert "pipeline" in __spark_entry__.queries()


def pairs_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def cut(text, spans):
    """The text without some word spans; white space between what stays may differ."""
    words = text.split()
    for start, n in sorted(spans, reverse=True):
        del words[start : start + n]
    return words


def test_stages_against_brute_force(spark):
    """Each stage on what its predecessor kept, over a whole small table."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    columns = docs.columns

    kept = common.written(P.language_id(spark, docs, sf), "a")
    assert kept.columns == columns
    ok = {r.doc_id for r in langid.identify(docs, langid.train_on(docs)).where("accepted").collect()}
    assert {i for i, _ in pairs_of(kept)} == ok

    rows = pairs_of(kept)
    single = common.written(P.near_duplicates(spark, kept, sf), "b")
    assert single.columns == columns and sorted(i for i, _ in pairs_of(single)) == sorted(i for i, c, _, _ in near(rows) if i == c)

    rows = dict(pairs_of(single))
    spans = {}
    for i, start, n, _, _ in repeats(list(rows.items()), 50):
        spans.setdefault(i, []).append((start, n))
    shorter = common.written(P.repeated_passages(spark, single, sf), "c")
    assert shorter.columns == columns
    assert {i: t.split() for i, t in pairs_of(shorter)} == {i: w for i, t in rows.items() if (w := cut(t, spans.get(i, []))) or i not in spans}

    rows = pairs_of(shorter)
    clean = common.written(P.decontamination(spark, shorter, sf), "d")
    dirty = {i for i, _, _, _ in leaks(rows, items)}
    assert dirty and clean.columns == columns and {i for i, _ in pairs_of(clean)} == {i for i, _ in rows} - dirty

    packed(P.best_fit_packing(spark, clean, sf), pairs_of(clean), 4096)


def test_decisions_of_planted_cases(spark):
    r = random.Random(1)
    item = prose(r, 14)
    body = prose(r, 70)
    rows = [(1, prose(r, 80)), (3, prose(r, 90) + " " + body), (4, body + " " + prose(r, 120)), (5, prose(r, 10) + " " + item)]
    rows.append((2, rows[0][1].replace("amber", "other", 1)))
    df = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = ngram_join.keep_one(df, ngram_join.ngram_jaccard_join(df))
    assert {i for i, _ in pairs_of(left)} == {1, 3, 4, 5}
    left = suffix_dedup.suffix_array_stage(left)
    assert body in dict(pairs_of(left))[3] and body not in dict(pairs_of(left))[4]
    left = decontaminate.drop_contaminated(left, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert {i for i, _ in pairs_of(left)} == {1, 3, 4}
