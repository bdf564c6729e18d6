"""Repeated word windows against brute force, and on odd input."""

import hashlib
import random

import numpy as np

from spendtide.llm import substrings

DOC = "doc_id bigint, text string"
LAST = substrings.LAST


def brute(rows, length):
    split = [((text or "").encode()).split() for _, text in rows]
    order = [LAST if d is None else d for d, _ in rows]
    least = {}
    for d, w in zip(order, split):
        for i in range(len(w) - length + 1):
            key = tuple(w[i : i + length])
            least[key] = min(d, least.get(key, d))
    out = []
    for (d, _), o, w in zip(rows, order, split):
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if least[tuple(w[i : i + length])] < o:
                gone[i : i + length] = [True] * length
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()), key=str)


def texts(rng, n):
    passages = [[f"p{rng.randrange(300)}" for _ in range(rng.randrange(20, 160))] for _ in range(8)]
    for _ in range(n):
        out = []
        for _ in range(rng.randrange(1, 5)):
            out += [f"v{rng.randrange(50)}" for _ in range(rng.randrange(40))]
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            out += p[a:] if rng.random() < 0.5 else p
        yield " ".join(out)


def test_shared_passages(spark):
    rng = random.Random(5)
    rows = list(enumerate(texts(rng, 150)))
    rows += [(i + 1000, t) for i, t in rows[:20]]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, DOC)
    for length in (50, 23, 101):
        assert got(substrings.repeated_words(df, length)) == brute(rows, length), length


def test_spans_are_the_removed_words(spark):
    a = [f"a{i}" for i in range(60)]
    rows = [(1, " ".join(["x", *a, "y"])), (2, " ".join(["q", "r", *a[5:58], "s"])), (3, " ".join(a[:49]))]
    out = {r.doc_id: r for r in substrings.repeated_words(spark.createDataFrame(rows, DOC), 50).collect()}
    assert [(s.begin, s.end) for s in out[2].spans] == [(2, 55)]
    assert out[1].spans == [] and out[3].n_removed == 0


def test_odd_rows(spark):
    run = " ".join(f"k{i}" for i in range(70))
    loop = " ".join(["again"] * 400)
    long = " ".join(f"L{i % 4001}" for i in range(500_000))
    rows = [
        (5, run), (5, run), (5, "other " + run), (3, "pre " + run), (None, run), (None, None), (1, None), (2, ""),
        (7, loop), (8, loop + " end"), (9, long), (10, long + " z"), (11, "nbsp joins   words"),
    ]
    df = spark.createDataFrame([(*r, "a", "b") for r in rows], DOC + ", id string, spans string")
    assert got(substrings.repeated_words(df, 50)) == brute(rows, 50)


def test_empty_table(spark):
    assert substrings.repeated_words(spark.createDataFrame([], DOC), 50).count() == 0


def test_levels_double():
    assert substrings.levels(50) == [25, 50]
    assert substrings.levels(200) == [25, 50, 100, 200]
    assert all(b <= 2 * a for n in range(2, 300) for a, b in zip(substrings.levels(n), substrings.levels(n)[1:]))


def test_window_hashes_depend_on_words_alone():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 2**63, 500, dtype=np.uint64)
    codes[300:400] = codes[100:200]
    for length in (1, 2, 7, 25, 50):
        for which in (0, 1):
            h = substrings.window_hashes(codes, length, which)
            assert len(h) == 501 - length
            assert (h[300 : 401 - length] == h[100 : 201 - length]).all()
            assert len(np.unique(h)) == 400  # the copied hundred words add no window of their own but at its edges


def test_least_places_takes_the_first_of_equals():
    keys = np.array([5, 1, 1, 7, 0, 0, 3], np.uint64)
    for width in range(1, 8):
        want = [i + int(keys[i : i + width].argmin()) for i in range(len(keys) - width + 1)]
        assert substrings.least_places(keys, width).tolist() == want
