"""Pfair mixing: deviation, completeness, odd input."""

import random

import pytest
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spendtide.llm import mixing

DOC = "doc_id bigint, text string, source string"


@given(st.lists(st.integers(1, 40), min_size=1, max_size=9))
@settings(max_examples=150, deadline=None)
def test_less_than_one_block_from_the_share(weights):
    slots = mixing.period({f"s{i}": w for i, w in enumerate(weights)})
    total = sum(weights)
    assert sorted(t for s in slots.values() for t in s) == list(range(total))
    for i, w in enumerate(weights):
        given_ = 0
        for t in range(total + 1):
            assert abs(given_ * total - w * t) < total  # less than one block
            given_ += t in slots[f"s{i}"]


@given(st.lists(st.tuples(st.integers(1, 60), st.integers(1, 9)), min_size=1, max_size=6))
@settings(max_examples=100, deadline=None)
def test_phases_give_every_block_once(sources):
    blocks = {f"s{i}": b for i, (b, _) in enumerate(sources)}
    weights = {f"s{i}": w for i, (_, w) in enumerate(sources)}
    at = {}
    for s, own in mixing.phases(blocks, weights).items():
        k = 0
        for first, n, w, total, offset, slots in own:
            assert first == k
            for j in range(n):
                slot = offset + j // w * total + slots[j % w]
                assert slot not in at
                at[slot] = s
            k += n
        assert k == blocks[s]
    assert sorted(at) == list(range(sum(blocks.values())))


def brute(rows, weights, block_bytes):
    """One heap over all blocks, block by block, with the sources that are left."""
    by = {}
    for r in rows:
        by.setdefault(r.source or "", []).append(r)
    blocks = {s: max(r.block_ for r in rs) + 1 for s, rs in by.items()}
    given_, out, offset = dict.fromkeys(blocks, 0), {}, 0
    while live := sorted(s for s in blocks if given_[s] < blocks[s]):
        total, start = sum(weights.get(s, 1) for s in live), dict(given_)
        t = 0
        while all(given_[s] < blocks[s] for s in live):
            ready = []
            for s in live:
                j, w = given_[s] - start[s], weights.get(s, 1)
                if j * total // w <= t:
                    ready.append((-(-(j + 1) * total // w), s))
            _, s = min(ready)
            out[s, given_[s]] = offset + t
            given_[s] += 1
            t += 1
        offset += t
    return out


def test_documents_against_a_plain_schedule(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    weights = {"src0": 3, "src4": 2}
    out = mixing.mix(docs, weights, block_bytes=3000)
    rows = out.collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    want = brute(rows, weights, 3000)
    assert all(r.slot_ == want[r.source, r.block_] for r in rows)
    ends = {}
    for r in sorted(rows, key=lambda r: (r.source, r.start_)):
        assert r.start_ == ends.get(r.source, 0) and r.block_ == r.start_ // 3000
        ends[r.source] = r.start_ + len(r.text.encode()) + 1


def test_odd_rows(spark):
    rows = [(1, None, None), (None, "a", "x"), (2, "b", "x"), (2, "b", "x"), (3, "c" * 5000, ""), (4, "", "y")]
    df = spark.createDataFrame([(*r, "z") for r in rows], DOC + ", slot_ string")
    out = mixing.mixed(df, {}, block_bytes=100)
    assert out.columns == df.columns
    assert sorted(out.collect(), key=str) == sorted(df.collect(), key=str)
    assert mixing.mix(df, {}, block_bytes=100).count() == 6


def test_order_of_a_mix_with_a_hot_source(spark):
    rng = random.Random(2)
    rows = [(i, "t" * rng.randrange(300), "hot" if i % 3 else f"s{i % 7}") for i in range(400)]
    out = mixing.mix(spark.createDataFrame(rows, DOC), {"hot": 5}, block_bytes=400)
    first = out.filter(F.col("slot_") < 24).groupBy("source").agg(F.countDistinct("slot_").alias("n")).collect()
    n = {r.source: r.n for r in first}
    assert 9 <= n["hot"] <= 11  # 5 of 12 shares of 24 slots


def test_empty_table_and_bad_weights(spark):
    df = spark.createDataFrame([], DOC)
    assert mixing.mix(df, {}).count() == 0 and mixing.mixed(df, {}).count() == 0
    with pytest.raises(ValueError, match="weights"):
        mixing.mix(spark.createDataFrame([(1, "a", "x")], DOC), {"x": 0})
