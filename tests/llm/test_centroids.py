import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from nodeloom.llm import centroids as C

WORDS = {"en": ["the", "with", "thing", "whole", "other", "which"], "de": ["der", "und", "nicht", "schön", "über", "zwischen"], "ru": ["что", "это", "дом", "река", "слово", "жизнь"]}


def rows(n, seed=1):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choices(WORDS[lang], k=rng.randint(5, 60))), lang) for i in range(n) for lang in [rng.choice(sorted(WORDS))]]


def test_held_out_accuracy(spark):
    data = rows(600)
    frame = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = C.learn(frame, sample=80)
    got = {r.doc_id: r for r in C.identified(frame, model).join(frame.select("doc_id", C.held_out(F.col("doc_id")).alias("out")), "doc_id").collect()}
    assert all(got[i].out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, *_ in data)
    assert sum(got[i].lang_pred == lang for i, _, lang in data if got[i].out) >= 0.98 * sum(r.out for r in got.values())
    assert all(0 <= r.score <= 1 for r in got.values()) and sum(r.rejected for r in got.values()) <= 2
    assert len(model.owner) == 12


def test_cases(spark):
    model = C.fit([(lang, x) for _, x, lang in rows(200)])
    frame = spark.createDataFrame([(1, None, "en"), (2, "", "x"), (3, "123 !?", None), (4, "über und nicht " * 200000, None), (4, "qqq zzz jjj xxx kkk " * 5, "en"), (None, "the thing", "en")], "doc_id long, text string, score string")
    got = [(r.doc_id, r.lang_pred, r.rejected) for r in C.identified(frame, model).collect()]
    assert got == [(1, "und", True), (2, "und", True), (3, "und", True), (4, "de", False), (4, got[4][1], True), (None, "en", False)]
    assert C.identified(frame.limit(0), model).count() == 0
    none = C.fit([])
    assert none.predict("text") == ("und", 0.0, True)


def test_blocks_count_the_same():
    text = "".join(random.Random(2).choices("abc déf.", k=1000))
    whole = C.counts(text)
    was, C._BLOCK = C._BLOCK, 7
    try:
        parts = C.counts(text)
    finally:
        C._BLOCK = was
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts, strict=True))
