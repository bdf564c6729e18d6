"""Mixing sources to target weights by Pfair scheduling of blocks."""

import heapq
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendtide.llm.common import carried, restored, running_total, staged

#: Bytes of a block.
BLOCK_BYTES = 64 * 1024
#: Sources, and slots of one period (the sum of all weights), that a schedule is made for.
MAX_SOURCES, MAX_PERIOD = 10_000, 100_000

PHASE = "struct<first:bigint,n:bigint,weight:int,period:int,offset:bigint,slots:array<int>>"


def period(weights: Mapping[str, int]) -> dict[str, list[int]]:
    """Each source's slots in one period of sum(weights) slots.

    Block j (from 1) of a source of weight w is released at floor((j-1) * period / w) and due at
    ceil(j * period / w). Every slot goes to the released block that is due first, the first name
    at a tie. On one processor this meets every deadline, so at any time a source is less than one
    block away from its share.
    """
    total = sum(weights.values())
    slots: dict[str, list[int]] = {s: [] for s in weights}
    waiting = [(0, s, 1) for s in sorted(weights)]
    ready: list[tuple[int, str, int]] = []
    for t in range(total):
        while waiting and waiting[0][0] <= t:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-j * total // weights[s]), s, j))
        _, s, j = heapq.heappop(ready)
        slots[s].append(t)
        if j < weights[s]:
            heapq.heappush(waiting, (j * total // weights[s], s, j + 1))
    return slots


def phases(blocks: Mapping[str, int], weights: Mapping[str, int]) -> dict[str, list[tuple]]:
    """Each source's phases (first block, blocks, weight, period, first slot, slots).

    A phase ends when a source has given its last block; the others go on by their weights.
    """
    out: dict[str, list[tuple]] = {s: [] for s in blocks}
    given, offset = dict.fromkeys(blocks, 0), 0
    while live := {s: weights[s] for s in blocks if given[s] < blocks[s]}:
        slots, total = period(live), sum(live.values())
        at = lambda s, k: k // live[s] * total + slots[s][k % live[s]]
        length = min(at(s, blocks[s] - given[s] - 1) for s in live) + 1
        for s, w in live.items():
            n = length // total * w + sum(x < length % total for x in slots[s])
            if n:
                out[s].append((given[s], n, w, total, offset, slots[s]))
                given[s] += n
        offset += length
    return out


def mix(docs: DataFrame, weights: Mapping[str, int], default: int = 1, source: str = "source", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`docs` with block_, slot_ and start_: ordered by (slot_, start_), the sources stand in their target weights.

    A source's documents, in order of a hash of their id and text, are cut into blocks of `block_bytes`
    (UTF-8 bytes of the text plus one each; a document belongs to the block that it starts in). Blocks
    of all sources are scheduled by `phases`: at any slot of a phase each source has given less than one
    block more or less than its share. `weights` are whole numbers; sources that it lacks weigh `default`.
    Every document is there once: a source that is used up leaves, and the others keep their proportions.

    The schedule of one period is made on the driver, from the number of blocks of each source; it does not
    grow with the documents. What a document needs of it is computed in its row. Prefix sums go
    by ranges of narrow rows, so a source with a third of all rows is no task of its own, and texts move once.

    A null source is the source '', a null text has one byte. A null id is an id like others. Rows that agree in
    id, text and source stand at one place, one behind the other. An empty table gives no rows. Columns of `docs` named block_, slot_, start_ are replaced.
    """
    own = [c for c in docs.columns if c not in ("block_", "slot_", "start_")]
    text = F.col("text").cast("string")
    keys = {
        "of_": F.coalesce(F.col(source).cast("string"), F.lit("")),
        "order_": F.xxhash64("doc_id", text), "key_": F.xxhash64(F.lit(1), text, "doc_id"),
    }
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint")
    rows = docs.select(*[v.alias(k) for k, v in keys.items()], size.alias("size_"))
    rows = rows.groupBy(*keys).agg(F.sum("size_").alias("size_"))
    rows = running_total(rows, "of_", ["order_", "key_"], F.col("size_"), "start_")
    rows = rows.withColumn("block_", F.floor(F.col("start_") / block_bytes).cast("bigint"))
    ends = rows.groupBy("of_").agg(F.max("block_").alias("last")).limit(MAX_SOURCES + 1).collect()
    blocks = {r["of_"]: r["last"] + 1 for r in ends}
    share = {s: int(weights.get(s, default)) for s in blocks}
    if len(blocks) > MAX_SOURCES or sum(share.values()) > MAX_PERIOD or min(share.values(), default=1) < 1:
        raise ValueError("weights must be whole numbers from 1; at most 10,000 sources and a sum of 100,000")
    plan = docs.sparkSession.createDataFrame(list(phases(blocks, share).items()), f"of_ string, phases_ array<{PHASE}>")
    now = F.get(F.filter("phases_", lambda p: (F.col("block_") >= p["first"]) & (F.col("block_") < p["first"] + p["n"])), F.lit(0))
    k = F.col("block_") - F.col("p_.first")
    turn = F.floor(k / F.col("p_.weight")).cast("bigint")
    slot = F.col("p_.offset") + turn * F.col("p_.period") + F.get(F.col("p_.slots"), (k - turn * F.col("p_.weight")).cast("int"))
    placed = rows.join(plan, "of_").withColumn("p_", now).select(*keys, "block_", slot.cast("bigint").alias("slot_"), "start_")
    # Both sides grow with the documents, so neither is broadcast, also where it is still small.
    wide = docs.select(*own, *[v.alias(k) for k, v in keys.items()])
    return wide.join(staged(placed, "placed").hint("merge"), list(keys)).select(*own, "block_", "slot_", "start_")


def mixed(docs: DataFrame, weights: Mapping[str, int], source: str = "source", **options) -> DataFrame:
    """The documents in mixed order; the columns of `docs`."""
    rows = carried(docs, doc_id=F.col("doc_id"), text=F.col("text"), source=F.col(source))
    return restored(mix(rows, weights, **options).orderBy("slot_", "start_"), docs)
