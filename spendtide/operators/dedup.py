"""First document per natural key, and insert-only loading against a target.

No key gathers its rows in one task. The rank filter of `first_per_key` becomes a
group limit that runs before the shuffle, so each map task sends at most one row
per key however many copies it holds.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendtide.session import Stages, staged

# The natural key of a creative.
KEY = ["source_id", "source"]


def total_order(df: DataFrame, first: str = "ingested_at") -> list:
    """Earliest first, then every other column, so equal ranks are equal rows."""
    rest = [c for c in df.columns if c != first and c not in KEY]
    return [F.asc_nulls_last(first)] + [F.asc_nulls_last(c) for c in rest]


def first_per_key(df: DataFrame, keys: list[str] = KEY, order: list | None = None) -> DataFrame:
    """One row per key: the first in the given order (default: earliest ingested)."""
    w = Window.partitionBy(*keys).orderBy(*(order or total_order(df)))
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def complete(keys: list[str] = KEY) -> Column:
    """Whether a row has its whole key; an empty text is no part of one."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).isNotNull() & (F.col(k).cast("string") != "")
    return out


def new_keys(batch: DataFrame, target: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Complete keys of `batch` that the target does not hold, each once.

    Only key columns move. The target is first cut down to the keys the batch also has. That side
    of the join has no more rows than the batch, so when the batch is small the planner
    broadcasts it and the target is read without a shuffle. The target is taken to
    hold each key once, as this kind of loading leaves it.
    """
    asked = batch.filter(complete(keys)).select(*keys).distinct()
    known = target.select(*keys).join(asked, keys, "left_semi")
    return asked.join(known, keys, "left_anti")


#: What a batch's key is to a target: held already, new and in one row of the batch, new and in several.
OLD, ONCE, OFTEN = "old", "once", "often"


def new_rows(batch: DataFrame, target: DataFrame, keys: list[str] = KEY, stages: Stages | None = None) -> DataFrame:
    """Rows of `batch`, first per key, whose key the target does not hold.

    A row without its whole key is not among them: it would be new each time. Keys alone are counted and compared, and
    written by their state. Rows are then picked by the fewer keys, those that bring a row or those that bring none: where they
    are few, the planner sends them to the rows and no row moves. Where they are many, a sieve of them is sent instead, and only
    rows that it cannot tell apart move (`_sieved`). Only rows of new keys that the batch holds several of are
    ranked. `batch` is read up to three times, so pass a written table.
    """
    write = stages.write if stages else staged
    whole = batch.filter(complete(keys))
    asked = whole.groupBy(*keys).agg(F.count("*").alias("_n"))
    known = target.select(*keys).withColumn("_held", F.lit(True))
    state = F.when(F.col("_held"), OLD).when(F.col("_n") == 1, ONCE).otherwise(OFTEN).alias("_state")
    states = write(asked.join(known, keys, "left").select(*keys, state), "keys", "_state")
    count = dict(states.groupBy("_state").count().collect())

    def of(*some: str) -> DataFrame:
        return states.filter(F.col("_state").isin(*some)).select(*keys)

    once, held, often = (count.get(s, 0) for s in (ONCE, OLD, OFTEN))
    # A map that would tell few rows apart is not made.
    maps = {"_bars": [OLD, OFTEN]} if held + often > SIEVED and 10 * once > held + often else {}
    maps |= {"_brings": [ONCE, OFTEN]} if once + often > SIEVED and 10 * held > once + often else {}
    if maps:
        out, unsure = _sieved(whole, states, once + held + often, maps, keys, write)
        # Not a semi or anti join: the planner would move it below the sieve, to all rows. A new key has one state.
        if held and once + often <= held:
            unsure = unsure.join(of(ONCE, OFTEN), keys)
        elif held:
            unsure = unsure.join(of(OLD).withColumn("_held", F.lit(True)), keys, "left").filter(F.col("_held").isNull())
        return out.select(*batch.columns).unionByName(first_per_key(unsure.select(*batch.columns), keys))
    if once <= held + often:
        out = whole.join(of(ONCE), keys, "left_semi") if ONCE in count else whole.filter(F.lit(False))
    else:
        out = whole.join(of(OLD, OFTEN), keys, "left_anti") if len(count) > 1 else whole
    out = out.select(*batch.columns)
    if OFTEN in count:
        out = out.unionByName(first_per_key(whole.join(of(OFTEN), keys, "left_semi").select(*batch.columns), keys))
    return out


#: Keys from which on a sieve is worth its making. Its bits: per key, and at most, which bounds what is sent to every executor
#: (32 MB a map) whatever the number of keys. Longs in a row of it.
SIEVED, PER_KEY, MOST_BITS, PAGE = 100_000, 8, 1 << 28, 512


def _sieved(
    whole: DataFrame, states: DataFrame, total: int, maps: dict[str, list[str]], keys: list[str], write: Callable
) -> tuple[DataFrame, DataFrame]:
    """(rows that are surely the only one of a new key, rows of which that is not sure); all other rows surely have a held key.

    Maps of bits, by a hash of the key: `_brings` where a new key falls, `_bars` where one falls that is held or in several rows. What is
    not barred is the only row of a new key, what brings nothing has a held key. A row that shares its bit with keys of the other kind is
    not sure; the more keys, the more of those, and all that is wrong with them is that they move.
    """
    bits = 1 << min(max((PER_KEY * total).bit_length(), (64 * PAGE).bit_length()), MOST_BITS.bit_length()) - 1
    bit = F.pmod(F.xxhash64(*keys), F.lit(bits))
    wanted = sorted({state for some in maps.values() for state in some})
    one = F.expr("shiftleft(1L, cast(_bit & 63 AS int))")
    longs = states.filter(F.col("_state").isin(*wanted)).withColumn("_bit", bit).select(
        F.shiftright("_bit", 6).alias("_long"), *[F.when(F.col("_state").isin(*some), one).otherwise(0).alias(m) for m, some in maps.items()]
    ).unionAll(states.sparkSession.range(bits // 64).select("id", *[F.lit(0).cast("bigint") for _ in maps]))
    longs = longs.groupBy("_long").agg(*[F.bit_or(m).alias(m) for m in maps])
    pages = longs.groupBy(F.expr(f"_long div {PAGE}").alias("_page")).agg(F.array_sort(F.collect_list(F.struct("_long", *maps))).alias("_longs"))
    sieve = write(pages.select("_page", *[F.col(f"_longs.{m}").alias(m) for m in maps]), "sieve")

    def hit(m: str) -> Column:
        return F.expr(f"(shiftright(get({m}, cast((_bit div 64) % {PAGE} AS int)), cast(_bit & 63 AS int)) & 1) = 1") if m in maps else F.lit(True)

    rows = whole.withColumn("_bit", bit).withColumn("_page", F.expr(f"_bit div {64 * PAGE}")).join(F.broadcast(sieve), "_page")
    return rows.filter(~hit("_bars")), rows.filter(hit("_bars") & hit("_brings"))


def upsert_counts(batch: DataFrame, target: DataFrame, by: list[str] | None = None, keys: list[str] = KEY) -> DataFrame:
    """upserted, modified, errors: in one row, or one per value of the columns `by`.

    Existing keys are never changed; a row that lacks part of its key cannot be stored
    and counts as an error.
    """
    by = by or []

    def marked(df: DataFrame, up: int, err: int) -> DataFrame:
        return df.select(*by, F.lit(up).alias("up"), F.lit(err).alias("err"))

    stored = new_rows(batch, target, keys) if set(by) - set(keys) else new_keys(batch, target, keys)
    outcomes = marked(stored, 1, 0).unionAll(marked(batch.filter(~complete(keys)), 0, 1))
    if by:  # a group that stored nothing still has its row
        outcomes = outcomes.unionAll(marked(batch.select(*by).distinct(), 0, 0))
    return outcomes.groupBy(*by).agg(
        F.coalesce(F.sum("up"), F.lit(0)).cast("bigint").alias("upserted"),
        F.lit(0).cast("bigint").alias("modified"),
        F.coalesce(F.sum("err"), F.lit(0)).cast("bigint").alias("errors"),
    )


def union_sources(*frames: DataFrame) -> DataFrame:
    """All sources under one set of columns; a column a source lacks is null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
