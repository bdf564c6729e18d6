"""K-d tree sharding."""

import random

import pytest

from pyspark.sql import functions as F

from spendtide.llm import sharding

ROW = "id bigint, x bigint, y bigint, size bigint"


def shards(spark, rows, n, schema=ROW):
    return sharding.kd_shards(spark.createDataFrame(rows, schema), ["x", "y"], "size", ["id"], n)


def plain(rows, n):
    """The same tree, node by node."""
    def place(part, k, base):
        if k == 1 or not part:
            return {r[0]: base for r in part}
        spans = [(max(r[d] for r in part) - min(r[d] for r in part)) / (float(whole[d] or 1)) for d in (1, 2)]
        d = 1 if spans[0] >= spans[1] else 2
        part = sorted(part, key=lambda r: (r[d], r[0], r[1], r[2]))
        total, before, left, right = sum(r[3] for r in part), 0, [], []
        for r in part:
            (left if (2 * before + r[3]) * k <= 2 * total * (k // 2) else right).append(r)
            before += r[3]
        return place(left, k // 2, base) | place(right, k - k // 2, base + k // 2)

    whole = [0, *[max(r[d] for r in rows) - min(r[d] for r in rows) for d in (1, 2)]]
    return place(rows, n, 0)


@pytest.mark.parametrize("n", [1, 2, 5, 8])
def test_against_a_plain_tree(spark, n):
    rng = random.Random(n)
    rows = [(i, rng.randrange(1000), rng.choice([0, 0, 0, 5, rng.randrange(50)]), rng.randrange(1, 400)) for i in range(700)]
    got = {r.id: r.shard for r in shards(spark, rows, n).collect()}
    assert got == plain(rows, n)
    load = [0] * n
    for i, _, _, s in rows:
        load[got[i]] += s
    assert max(load) - min(load) <= 2 * 400 * 3


def test_one_value_for_most_rows_is_cut_through(spark):
    rows = [(i, 7, 7, 10) for i in range(800)] + [(1000 + i, i, 0, 10) for i in range(160)]
    n = shards(spark, rows, 8).groupBy("shard").count().collect()
    assert sorted(r["count"] for r in n) == [120] * 8


def test_odd_rows(spark):
    rows = [(1, None, None, 5), (None, 1, 2, 5), (2, 3, 4, 5), (2, 3, 4, 5), (3, 10**15, -(10**15), 10**9)]
    df = spark.createDataFrame([(*r, "s", 1, 2, 3, 4) for r in rows], ROW + ", shard string, shard_ int, k_ int, row_ int, `axis value` int")
    out = sharding.kd_shards(df, ["x", "y"], "size", ["id"], 4)
    assert out.columns == [c for c in df.columns if c != "shard"] + ["shard"]
    assert sorted((r.id or 0, r.shard_, r.k_, r.row_, r["axis value"]) for r in out.collect()) == [(i, 1, 2, 3, 4) for i in (0, 1, 2, 2, 3)]
    plain_ = {r.id: r.shard for r in shards(spark, rows, 4).collect() if r.id in (1, 3)}
    assert {r.id: r.shard for r in out.collect() if r.id in (1, 3)} == plain_
    assert shards(spark, [], 8).count() == 0
    assert shards(spark, [(1, 1, 1, 1)], 8).count() == 1


@pytest.mark.parametrize("target", [1, 300, 1000, 10**9])
def test_leaves_reach_the_target_bytes(spark, target):
    rng = random.Random(target)
    rows = [(i, rng.randrange(1000), rng.choice([0, 0, 5]), rng.randrange(1, 40)) for i in range(300 if target > 1 else 9)]
    df = spark.createDataFrame(rows, ROW)
    out = sharding.kd_shards(df, ["x", "y"], "size", ["id"], target_bytes=target).groupBy("shard").sum("size").collect()
    assert max(r[1] for r in out) <= target + 40 * 2
    assert max(r.shard for r in out) < -(-sum(r[3] for r in rows) // target)
    assert sharding.kd_shards(df.limit(0), ["x", "y"], "size", ["id"], target_bytes=target).count() == 0
    with pytest.raises(ValueError):
        sharding.kd_shards(df, ["x"], "size", ["id"], 2, target)


def test_numbers_are_gapless(spark):
    df = spark.range(3000).withColumn("g", F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 7)).withColumn("v", F.floor(-F.col("id") / 2))
    by = {}
    for r in sharding.number_rows(df, "g", ["v"], "slot").collect():
        by.setdefault(r.g, []).append((r.slot, r.v))
    for rows in by.values():
        rows.sort()
        assert [s for s, _ in rows] == list(range(len(rows))) and [v for _, v in rows] == sorted(v for _, v in rows)


def test_numbering_beside_columns_of_any_name(spark):
    df = spark.range(20).selectExpr("id", "id % 2 AS g", "'a' AS range_", "'b' AS own_", "'c' AS value_", "7 AS slot")
    out = sharding.number_rows(df, "g", ["id"], "slot")
    assert out.columns == ["id", "g", "range_", "own_", "value_", "slot"]
    assert sorted((r.id, r.slot, r.range_ + r.own_ + r.value_) for r in out.collect()) == [(i, i // 2, "abc") for i in range(20)]


def test_codes_are_ranks_in_byte_order(spark):
    """Also of texts that agree in many first letters."""
    names = ["", "a", "aa", "b", "commoncrawl-a", "commoncrawl-b", "https://x/1", "https://x/2", "src1", "src10", "src2", "é"]
    rows = [(n, None) for n in [*names, None, "src1", "src1"]]
    out = sharding.ranked_codes(spark.createDataFrame(rows, "n string, m string"), ["n", "m"])
    codes = {r.n: r.n_code for r in out.collect()}
    assert [codes[n] for n in sorted(names, key=lambda n: n.encode())] == list(range(len(names))) and codes[None] == -1
    assert out.count() == len(rows) and {r.m_code for r in out.collect()} == {-1}


def test_shards_as_folders(spark, tmp_path):
    out = shards(spark, [(i, i, i, 1) for i in range(40)], 4)
    sharding.write_shards(out, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted((r.id, r.shard) for r in back.collect()) == sorted((r.id, r.shard) for r in out.collect())
