import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from codewhiff.llm import langid as L
from helpers import rows_of, table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def net(spark):
    return L.train_on(spark.read.parquet(f"{SF}/documents.parquet"))


def test_held_out_accuracy(spark, net):
    """Other documents than those of sf0.01: ids from 1,000 on."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id >= 1000 and length(text) >= 40 and lang is not null")
    out = L.identify(docs, net).join(docs.select("doc_id", "lang"), "doc_id")
    one = out.agg(F.avg((F.col("predicted") == F.col("lang")).cast("double")).alias("right"), F.avg(F.col("accepted").cast("double")).alias("kept")).first()
    assert one.right > 0.97, one
    assert one.kept > 0.97, one


def test_windows_cover_the_whole_text():
    r = np.random.default_rng(1)
    texts = [bytes(r.integers(1, 255, n).astype(np.uint8)) for n in (0, 1, 5, 255, 256, 257, 700)]
    offs = np.r_[0, np.cumsum([len(t) for t in texts])]
    x, owner, weight = L.windows(np.frombuffer(b"".join(texts), dtype=np.uint8), offs)
    for i, t in enumerate(texts):
        assert b"".join(bytes(w[: L.WINDOW]) for w in x[owner == i])[: len(t)] == t
        assert weight[owner == i].sum() == len(t)


def test_gradient_reduces_loss():
    r = np.random.default_rng(2)
    x = r.integers(97, 110, (200, L.WINDOW + L.REACH)).astype(np.uint8)
    y = np.arange(200) % 2
    x[y == 1, 50:53] = [122, 120, 121]
    net = L.ByteConvNet(["a", "b"])
    net.train(x, y, epochs=20)
    assert (net.probabilities(x).argmax(axis=1) == y).mean() > 0.95


def test_odd_rows(spark, net):
    r = random.Random(1)
    junk = "".join(chr(r.randrange(0x2500, 0x2600)) for _ in range(300))
    rows = [(1, None), (2, ""), (None, "This is the text of a person who writes in English about the weather."), (3, junk), (4, "The weather of the day was good and the people were in the streets. " * 3000), (4, "ok")]
    out = L.identify(table(spark, rows, clash=True), net).collect()
    by = {}
    for row in out:
        by.setdefault(row.doc_id, []).append(row)
    assert len(out) == len(rows)
    assert by[1][0].predicted == by[2][0].predicted == L.UNKNOWN and not by[1][0].accepted and by[1][0].n_windows == 0
    assert not by[3][0].accepted
    assert max(x.n_windows for x in by[4]) == -(-len(rows[4][1]) // L.WINDOW)
    assert rows_of(L.identify(table(spark, []), net)) == []


def test_keep_identified_has_all_columns(spark, net):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("part", F.lit(1))
    kept = L.keep_identified(docs, net)
    assert kept.columns == docs.columns
    want = {r.doc_id for r in L.identify(docs, net).where("accepted").collect()}
    assert {r.doc_id for r in kept.select("doc_id").collect()} == want


def test_training_sample_is_bounded_and_least_by_hash(spark):
    docs = table(spark, [(i, f"text number {i} " * 5) for i in range(300)]).selectExpr("doc_id as id", "text", "'en' as label", "xxhash64(doc_id) as h")
    every = sorted(docs.collect(), key=lambda x: (x.label, x.h, x.id, x.text))
    bound = -(1 << 63) + (150 << 64) // 300
    assert [x.id for x in L._least(docs, {"en": bound}, 50)] == [x.id for x in every[:50]]


def test_training_on_nothing(spark):
    net = L.train_on(table(spark, []))
    assert net.classes == [L.UNKNOWN]
    assert [r.accepted for r in L.identify(table(spark, [(1, "some words")]), net).collect()] == [False]


def test_every_label_has_a_class(spark):
    rows = [(100 * k + i, f"lang{k:02d} " * 12, f"lang{k:02d}", "web", 84) for k in range(70) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert L.train_on(docs).classes == sorted({r[2] for r in rows}) + [L.UNKNOWN]
