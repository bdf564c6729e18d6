"""Exact top-k search by inner product with a pivot-distance index."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendtide.llm.common import scratch, staged

#: Pivots, annuli of each pivot, and rows of the sample that pivots are fitted on: bounds of what the driver holds.
PIVOTS, RINGS, SAMPLE = 16, 12, 4096
#: Vectors of a block and queries of a chunk, about.
BLOCK, CHUNK = 2048, 256
#: Results that a scoring task holds before it hands some on.
HELD = 500_000


def _quantise(scale: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            bounds = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
            keep, out, dims, norms = [], [], [], []
            for i in range(batch.num_rows):
                x = flat[bounds[i] : bounds[i + 1]]
                if lists[i].is_valid and len(x) and np.isfinite(x).all():
                    with np.errstate(over="ignore"):
                        x = np.floor(x * scale)
                    most = float(np.abs(x).max())
                    if len(x) * most * most < 2.0**62:
                        keep.append(i), out.append(x.astype("<i4").tobytes()), dims.append(len(x)), norms.append(int(x @ x) if most < 2**20 else int((x.astype(np.int64) ** 2).sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(pa.array(keep, pa.int64())), pa.array(dims, pa.int32()), pa.array(norms, pa.int64()), pa.array(out, pa.binary())],
                ["vec_id", "dim", "norm2", "vec"],
            )

    return each


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, dim).astype(np.float64)


def lifted(x: np.ndarray, norm2: np.ndarray, most: float) -> np.ndarray:
    """Vectors with one more component, so that all have the same length: near then means a large inner product."""
    return np.hstack([x, np.sqrt(np.maximum(most - norm2, 0.0))[:, None]])


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(square, 0.0))


def fit_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Centres of the sample: spread out first, then moved to the means of their cells a few times."""
    chosen = [0]
    near = distances(sample, sample[:1])[:, 0]
    while len(chosen) < min(n, len(sample)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, distances(sample, sample[chosen[-1:]])[:, 0])
    pivots = sample[chosen]
    for _ in range(4):
        cell = distances(sample, pivots).argmin(axis=1)
        pivots = np.stack([sample[cell == c].mean(axis=0) if (cell == c).any() else pivots[c] for c in range(len(pivots))])
    return pivots


def _key(pivots: np.ndarray, dim: int, most: float):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = lifted(_matrix(batch.column("vec"), dim), batch.column("norm2").to_numpy(), most)
            far = distances(x, pivots)
            cell = far.argmin(axis=1)
            yield batch.append_column("cell", pa.array(cell.astype(np.int32))).append_column("far", pa.array(far[np.arange(len(x)), cell]))

    return each


def _route(pivots: np.ndarray, rings: list, dim: int, most: float, nearest: int | None):
    """Rows (chunk, cell, ring): the annuli that some query of the chunk has to see.

    With `nearest`, those so many that come closest; else all that the bound does not rule out.
    """
    cells = np.array([r[0] for r in rings])
    inner, outer = np.array([r[2] for r in rings]), np.array([r[3] for r in rings])
    slack = 1e-6 * (np.sqrt(most) + 1)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            q = _matrix(batch.column("vec"), dim)
            norm2 = batch.column("norm2").to_numpy().astype(np.float64)
            far = distances(np.hstack([q, np.zeros((len(q), 1))]), pivots)[:, cells]
            bound = gap(far, inner, outer)
            if nearest:
                order = np.argsort(bound + 1e-9 * np.abs(far - (inner + outer) / 2), axis=1, kind="stable")[:, :nearest]
                need = np.zeros(bound.shape, bool)
                np.put_along_axis(need, order, True, axis=1)
            else:
                least = batch.column("least").to_numpy(zero_copy_only=False).astype(np.float64)
                reach = np.sqrt(np.maximum(norm2 + most - 2 * least, 0.0)) + slack
                need = np.isnan(least)[:, None] | (bound <= np.nan_to_num(reach)[:, None])
            i, j = np.nonzero(need)
            pairs = pa.table({
                "chunk": batch.column("chunk").take(pa.array(i)),
                "cell": pa.array(cells[j].astype(np.int32)), "ring": pa.array(np.array([r[1] for r in rings], np.int32)[j]),
            })
            yield from pairs.group_by(["chunk", "cell", "ring"]).aggregate([]).to_batches()

    return each


def gap(far: np.ndarray, inner: float, outer: float) -> np.ndarray:
    """By the triangle inequality: how far at least all vectors of an annulus are from points so `far` from its pivot."""
    return np.maximum(0.0, np.maximum(far - outer, inner - far))


def within_reach(q: np.ndarray, norm2: np.ndarray, least: np.ndarray, pivot: np.ndarray, inner: float, outer: float, most: float) -> np.ndarray:
    """Which queries a block can hold a candidate of, given each one's k-th score so far (NaN: none)."""
    far = distances(np.hstack([q, np.zeros((len(q), 1))]), pivot[None])[:, 0]
    reach = np.sqrt(np.maximum(norm2 + most - 2 * np.nan_to_num(least), 0.0)) + 1e-6 * (np.sqrt(most) + 1)
    return np.isnan(least) | (gap(far, inner, outer) <= reach)


class _Best:
    """The k best of each query over the blocks that a task has met, so that this much and no more leaves it."""

    def __init__(self, k: int):
        self.k, self.parts, self.size, self.kept = k, [], 0, 0

    def add(self, *columns: np.ndarray) -> None:
        self.parts.append(columns)
        self.size += len(columns[0])

    def merged(self) -> list[np.ndarray]:
        if not self.parts:
            return [np.zeros(0, np.int64)] * 4
        row, ids, vec, score = (np.concatenate(c) for c in zip(*self.parts))
        order = np.lexsort((vec, -score, row))
        row = row[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row, "left")
        top = order[rank < self.k]
        out = [np.concatenate(c)[top] for c in zip(*self.parts)]
        self.parts, self.size, self.kept = [tuple(out)], len(top), len(top)
        return out

    def batch(self) -> pa.RecordBatch:
        out = self.merged()
        self.parts, self.size, self.kept = [], 0, 0
        return pa.RecordBatch.from_arrays([pa.array(o.astype(np.int64)) for o in out], ["row", "query_id", "vec_id", "score"])


def _score(dim: int, k: int, pivots: np.ndarray, most: float):
    """The k best of all blocks that a task meets, for each query that the block's bound does not rule out."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(k)
        for batch in batches:
            for one in batch.to_pylist():
                rows, ids = np.array(one["rows"], np.int64), np.array(one["query_ids"], np.int64)
                vec_ids = np.array(one["vec_ids"], np.int64)
                q, x = (np.frombuffer(b"".join(one[c]), "<i4").reshape(-1, dim) for c in ("queries", "vecs"))
                least = np.array([np.nan if v is None else float(v) for v in one["leasts"]])
                need = within_reach(q.astype(np.float64), np.array(one["norms"], np.float64), least, pivots[one["cell"]], one["inner"], one["outer"], most)
                if not need.any():
                    continue
                rows, ids, q = rows[need], ids[need], q[need]
                exact = dim * float(np.abs(q.astype(np.int64)).max()) * float(np.abs(x.astype(np.int64)).max()) < 2.0**53
                kind = np.float64 if exact else np.int64
                scores = (q.astype(kind) @ x.astype(kind).T).astype(np.int64)
                for i in range(len(rows)):
                    mine = np.flatnonzero(vec_ids != ids[i])
                    s = scores[i, mine]
                    if len(s) > k:
                        edge = np.partition(s, len(s) - k)[len(s) - k]
                        mine, s = mine[s >= edge], s[s >= edge]
                    top = mine[np.lexsort((vec_ids[mine], -s))[:k]]
                    best.add(np.full(len(top), rows[i]), np.full(len(top), ids[i]), vec_ids[top], scores[i, top])
                if best.size > HELD + 2 * best.kept:
                    best.merged()
                    if best.kept > HELD:
                        yield best.batch()
        yield best.batch()

    return each


@scratch
def top_k(vectors: DataFrame, is_query, k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest integer inner products of each query.

    A vector's components become floor(scale * x). Rows for which the column `is_query` holds are the queries;
    candidates are all rows but those with the query's own vec_id. Ties go to the smaller vec_id.

    1. Vectors are lifted to one common length, so that a large inner product is a small distance. PIVOTS are
       fitted on SAMPLE rows (least hash of their id); every vector is keyed by its nearest pivot and distance.
       RINGS quantiles of the distances cut each cell into annuli, and blocks of about BLOCK vectors cut an annulus.
       So a vector that a third of all rows repeat fills many blocks of one annulus.
    2. Each query sees a block of the annuli nearest to it, which gives it a k-th best score.
    3. By the triangle inequality nothing in an annulus is nearer than the gap between the query's
       distance to the pivot and the annulus. It sees all blocks of the annuli whose gap is within reach of its k-th score,
       and no others: the result is exact. A margin covers the rounding of distances; scores are whole numbers.

    Queries travel in chunks of about CHUNK, blocks as one row each; a task holds one of both at a time. Where a chunk meets
    a block, the bound is taken again for each of its queries and the block's own distances, and only those within reach are
    scored. A task merges what it finds and hands on at most k results of each query.

    Vectors that are null or empty, hold a null, NaN or infinite component, are so large that scores pass 64 bits, or have
    another length than most (the smaller length at a tie), and rows without vec_id, take no part.
    Repeated vec_ids are candidates each; as queries, each row has an answer of its own. An empty table gives no rows.
    """
    out_schema = "query_id bigint, rank int, vec_id bigint, score bigint"
    spark = vectors.sparkSession
    rows = vectors.filter("vec_id is not null").select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.mapInArrow(_quantise(scale), "vec_id bigint, dim int, norm2 bigint, vec binary")
    rows = staged(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    usual = rows.groupBy("dim").agg(F.count("*").alias("n"), F.max("norm2").alias("most")).orderBy(F.desc("n"), "dim").first()
    if usual is None:
        return spark.createDataFrame([], out_schema)
    dim = usual["dim"]
    rows = rows.filter(F.col("dim") == dim).drop("dim")
    most = float(usual["most"])
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "vec").limit(SAMPLE).select("norm2", "vec").toArrow()
    pivots = fit_pivots(lifted(_matrix(sample.column("vec").combine_chunks(), dim), sample.column("norm2").to_numpy(), most), PIVOTS)

    keyed = rows.select("row", "vec_id", "norm2", "vec")
    keyed = staged(keyed.mapInArrow(_key(pivots, dim, most), "row bigint, vec_id bigint, norm2 bigint, vec binary, cell int, far double"), "keyed")
    cuts = [i / RINGS for i in range(1, RINGS)]
    edges = keyed.groupBy("cell").agg(F.percentile_approx("far", cuts, 2000).alias("cuts"))
    cell = keyed.join(staged(edges, "edges"), "cell")
    ringed = cell.withColumn("ring", F.aggregate("cuts", F.lit(0), lambda n, c: n + F.when(c < F.col("far"), 1).otherwise(0))).drop("cuts")
    ringed = staged(ringed, "ringed")
    rings = ringed.groupBy("cell", "ring").agg(F.min("far").alias("inner"), F.max("far").alias("outer"), F.count("*").alias("n"))
    rings = staged(rings, "rings")
    # At most PIVOTS * RINGS rows.
    directory = [tuple(r) for r in rings.select("cell", "ring", "inner", "outer").collect()]

    split = F.pmod(F.xxhash64("row"), F.ceil(F.col("n") / BLOCK)).cast("int")
    blocks = ringed.join(rings.select("cell", "ring", "n"), ["cell", "ring"]).withColumn("split", split)
    blocks = blocks.groupBy("cell", "ring", "split").agg(
        F.collect_list(F.struct("vec_id", "vec")).alias("m"), F.min("far").alias("inner"), F.max("far").alias("outer")
    )
    blocks = staged(blocks.select("cell", "ring", "split", "inner", "outer", F.col("m.vec_id").alias("vec_ids"), F.col("m.vec").alias("vecs")), "blocks")

    asked = ringed.filter(is_query).select("row", F.col("vec_id").alias("query_id"), "norm2", "vec", "cell")
    counts = asked.groupBy("cell").agg(F.count("*").alias("n"))
    chunk = F.col("cell") * F.lit(1 << 40) + F.pmod(F.xxhash64("row"), F.ceil(F.col("n") / CHUNK))
    asked = staged(asked.join(counts, "cell").select("row", "query_id", "norm2", "vec", chunk.alias("chunk")), "queries")

    def seen(routes: DataFrame, of: DataFrame, queries: DataFrame) -> DataFrame:
        chunks = queries.groupBy("chunk").agg(F.collect_list(F.struct("row", "query_id", "norm2", "vec", "least")).alias("q"))
        names = {"rows": "row", "query_ids": "query_id", "norms": "norm2", "queries": "vec", "leasts": "least"}
        chunks = staged(chunks.select("chunk", *[F.col(f"q.{c}").alias(n) for n, c in names.items()]), "chunks")
        met = chunks.join(routes.join(of, ["cell", "ring"]), "chunk").drop("chunk", "ring", "split")
        score = _score(dim, k, pivots, most)
        found = met.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(score, "row bigint, query_id bigint, vec_id bigint, score bigint")
        return staged(found, "found", keep=True)

    def best(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    routed = "chunk bigint, cell int, ring int"
    near = staged(asked.mapInArrow(_route(pivots, directory, dim, most, 2), routed).distinct(), "near")
    first = best(seen(near, blocks.filter("split = 0"), asked.withColumn("least", F.lit(None).cast("bigint"))))
    least = first.groupBy("row").agg(F.min("score").alias("least"), F.count("*").alias("n")).filter(F.col("n") == k)
    known = staged(asked.join(staged(least.select("row", "least"), "least"), "row", "left"), "known")
    routes = staged(known.mapInArrow(_route(pivots, directory, dim, most, None), routed).distinct(), "routes")
    return best(seen(routes, blocks, known)).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
