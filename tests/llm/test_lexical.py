"""Ranked lexical search against a score of every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from spendtide.llm import lexical

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return Counter(t.translate(LOWER) for t in WORD.findall(text or ""))


def brute(docs, items, k=10):
    made = [(d, c, sum(c.values())) for d, c in ((d, terms(x)) for d, x in docs) if c]
    n, words, df = len(made), sum(x for _, _, x in made), Counter(t for _, c, _ in made for t in c)
    out = []
    for item, text in items:
        w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in terms(text)}
        scored = []
        for d, c, size in made:
            m = 10 + (90 * size * n) // words
            score = sum(v * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, v in w.items() if t in c)
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def got(spark, docs, items, k=10):
    d = spark.createDataFrame([(*r, 1, 2, 3) for r in docs], "doc_id bigint, text string, n int, score int, shard int")
    q = spark.createDataFrame([(*r, "x") for r in items], "item_id bigint, text string, query string")
    return sorted(map(tuple, lexical.ranked_search(d, q, F.col("item_id"), k).collect()), key=repr)


def corpus(rng, n=400):
    words = [f"t{i}" for i in range(120)] + ["Älter", "straße", "一二", "x1"]
    weights = [1 / (i + 1) for i in range(len(words))]
    def text(size):
        return rng.choice([" ", ", ", "\n_"]).join(rng.choices(words, weights, k=size))

    return [(i * 3, text(rng.randrange(1, 80))) for i in range(n)], text


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(9)
    docs, text = corpus(rng)
    docs += [(5001, None), (5002, ""), (5003, "..."), (None, "t100 t101 t102"), (None, "t100 t101 t102"), (5004, text(20_000))]
    docs += [(9000 - i, "t90 t91 T92") for i in range(60)] + [(8000, "t93 t94")] * 3
    items = [(i, text(12)) for i in range(12)] + [(50, None), (51, ""), (52, "nowhere found"), (53, "t90 T91 t92 t92"), (53, "t93"), (None, "t94 t100 t100"), (54, text(400))]
    want = brute(docs, items)
    assert got(spark, docs, items) == want
    monkeypatch.setattr(lexical, "SHARD", 500)  # several shards in two waves
    monkeypatch.setattr(lexical, "STEP", 2)
    assert got(spark, docs, items) == want
    monkeypatch.setattr(lexical, "QUERIES", 4)  # several blocks
    assert got(spark, docs, items) == want
    assert got(spark, docs, items[:5], k=3) == brute(docs, items[:5], k=3)


def test_empty_tables(spark):
    assert got(spark, [], [(1, "a")]) == []
    assert got(spark, [(1, "a")], []) == []
    assert got(spark, [(1, None), (2, "")], [(1, "a")]) == []


def index(docs, vocabulary):
    number = {t: i for i, t in enumerate(vocabulary)}
    rows = [sorted((number[t], f) for t, f in terms(x).items()) for _, x in docs]
    df = Counter(t for r in rows for t, _ in r)
    n = np.array([sum(terms(x).values()) for _, x in docs])
    weights = np.array([math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * df[i] + 1))) for i in range(len(vocabulary))])
    flat = [p for r in rows for p in r]
    return lexical.Index(
        pa.array([d for d, _ in docs]), n, np.cumsum([0, *map(len, rows)]), np.array([t for t, _ in flat]), np.array([f for _, f in flat]),
        weights, len(docs), int(n.sum()),
    ), len(flat)


def test_most_postings_are_not_read():
    """Where a query has rare terms the lists of frequent ones stay unread, but for direct accesses."""
    rng = random.Random(2)
    docs, _ = corpus(rng, 4000)
    for i in range(30):
        docs.append((20_000 + i, "t119 t118 t117 " + docs[i][1]))
    vocabulary = sorted({t for _, x in docs for t in terms(x)})
    made, total = index(docs, vocabulary)
    query = np.array([vocabulary.index(t) for t in ("t0", "t1", "t2", "t117", "t118", "t119")])
    lists = int(sum(made.starts[t + 1] - made.starts[t] for t in query))
    rows, scores, reads = made.search(query, 10)
    assert len(rows) == 10 and reads < lists / 4
    assert (np.diff(scores) <= 0).all()


def test_a_known_floor_spares_reading_and_loses_nothing_above_it():
    rng = random.Random(3)
    docs, text = corpus(rng, 2000)
    vocabulary = sorted({t for _, x in docs for t in terms(x)})
    made, _ = index(docs, vocabulary)
    for _ in range(20):
        query = np.array(sorted({vocabulary.index(t) for t in terms(text(8))}))
        rows, scores, reads = made.search(query, 10)
        floor = int(scores[4])
        rows_, scores_, fewer = made.search(query, 10, floor)
        assert fewer <= reads
        kept = scores_ >= floor
        assert set(zip(rows_[kept], scores_[kept])) >= {(r, s) for r, s in zip(rows, scores) if s >= floor}
