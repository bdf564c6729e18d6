"""Importance resampling and its radix sort against plain Python."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spendtide.llm import sampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
DOCS = "doc_id bigint, text string"


def features(text):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute(docs, bench, share=5, least=20):
    s, t, made = [0] * 10000, [0] * 10000, []
    for d, x in docs:
        made.append((d, *features(x)))
        for b in made[-1][2]:
            s[b] += 1
    for x in bench:
        for b in features(x)[1]:
            t[b] += 1
    big_s, big_t = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in range(10000)]
    out = []
    for d, n, f in made:
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f)
        out.append([d, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((o for o in out if o[5] >= least), key=lambda o: (-o[3], o[0] is None, o[0] or 0))
    for i, o in enumerate(able[: share * len(able) // 100]):
        o[4] = i + 1
    return sorted(map(tuple, out), key=repr)


def got(spark, docs, bench, **options):
    target = spark.createDataFrame([(i, x) for i, x in enumerate(bench)], "item_id bigint, text string")
    out = sampling.resampled(spark.createDataFrame(docs, DOCS) if not isinstance(docs, tuple) else docs[0], target, **options)
    return sorted(map(tuple, out.collect()), key=repr)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abZ09äß一\U0001F600", min_size=1, max_size=12), max_size=9), st.integers(1, 4))
def test_checksums_of_runs(words, run):
    raw = [w.encode() for w in words]
    out = sampling.Checksums().of_runs(raw, run) if raw else np.zeros(0)
    want = [zlib.crc32(b" ".join(raw[i : i + n])) for n in range(1, run + 1) for i in range(len(raw) - n + 1)]
    assert out.tolist() == want


def test_checksums_of_very_long_words():
    raw = [b"a" * 255, b"b" * 256, b"c", b"d" * 100_000]
    sums = sampling.Checksums()
    for words in (raw, raw[:1] * 3, raw[2:3] * 5):
        want = [zlib.crc32(b" ".join(words[i : i + n])) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
        assert sums.of_runs(words, 3).tolist() == want


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(sampling, "CHUNK", 16)
    monkeypatch.setattr(sampling, "DIGIT", 5)
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ärger", "straße", "一二", "A1"]
    def text(n):
        return rng.choice([" ", ", ", "\n", "-"]).join(rng.choice(vocabulary) for _ in range(n))

    docs = [(i * 7 - 300, text(rng.randrange(0, 60))) for i in range(300)]
    docs += [(5000, None), (5001, ""), (5002, "!!! ..."), (5003, "x" * 3000 + " y" * 30), (None, text(40)), (None, text(30)), (5004, text(9000))]
    docs += [(6000 + i, "same words again and again " * 8) for i in range(90)] + [(7000, "twice " * 30)] * 2
    bench = [text(30), "same words", None, ""]
    out = got(spark, docs, bench, share=40)
    assert out == brute(docs, bench, share=40)
    assert got(spark, docs, [], share=5) == brute(docs, [], share=5)


def test_empty_and_clashing_columns(spark):
    assert got(spark, [], ["a b"]) == []
    docs = [(i, f"word{i} " * 25) for i in range(40)]
    df = spark.createDataFrame([(*d, 1, 2, "x", 3) for d in docs], DOCS + ", rank int, score int, at_ string, weight int")
    assert got(spark, (df,), ["word1 word1"]) == brute(docs, ["word1 word1"])


BIG = [-(1 << 63), (1 << 63) - 1, 0, -1, 1, 1 << 40, -(1 << 40)]


@pytest.mark.parametrize("chunk, digit", [(4, 3), (7, 11), (8192, 11)])
def test_radix_rank(spark, monkeypatch, chunk, digit):
    monkeypatch.setattr(sampling, "CHUNK", chunk)
    monkeypatch.setattr(sampling, "DIGIT", digit)
    rng = random.Random(chunk)
    rows = [(rng.choice([*BIG, None, 5, 5, 5]), rng.choice([1, 2, None, 900_000]), i) for i in range(60)]
    if digit == 3:  # fewer passes
        rows = [(None if a is None else a % 50, b, c) for a, b, c in rows]
    df = spark.createDataFrame(rows, "a bigint, b bigint, c bigint").repartition(5)
    out = sampling.radix_ranked(df, [("a", True), ("b", False)]).orderBy("rank").collect()
    assert [r["rank"] for r in out] == list(range(1, 61))
    def key(a, b):
        return (a is None, -(a or 0), b is None, b or 0)

    keys = [key(r.a, r.b) for r in out]
    assert keys == sorted(keys)
    assert sorted((r.a, r.b, r.c) for r in out if None not in (r.a, r.b)) == sorted(r for r in rows if None not in r)
    assert len({r.c for r in out}) == 60


@pytest.mark.parametrize("rows", [[], [(3, 1, 0)], [(3, 1, 0)] * 4, [(None, None, 1)] * 3])
def test_radix_rank_of_equal_rows(spark, rows):
    df = spark.createDataFrame(rows, "a bigint, b bigint, c bigint")
    assert sorted(r["rank"] for r in sampling.radix_ranked(df, [("a", True), ("b", False)]).collect()) == list(range(1, len(rows) + 1))
