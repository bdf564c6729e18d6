"""Substring dedup: windows of words that repeat at one length are extended to twice that length."""

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendtide.llm.common import scratch, staged
from spendtide.llm.tokens import U64, WordCodes, code_words, mix, split_words

#: Words that Python handles at a time, about; a longer document is handled alone.
CHUNK_WORDS = 400_000
#: No first level shorter than this: below it nearly all windows repeat.
LEAST_WINDOW = 20
LAST = (1 << 63) - 1
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def levels(min_words: int) -> list[int]:
    """Window lengths from the first level up to `min_words`; each is at most twice the one before."""
    out = [min_words]
    while -(-out[0] // 2) >= LEAST_WINDOW:
        out.insert(0, -(-out[0] // 2))
    return out


def window_hashes(codes: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """Hash of every window of `length` words, by doubling: a window's from those of its halves."""
    base = _BASES[which]
    one = mix(codes + U64(which)) if which else codes
    with np.errstate(over="ignore"):
        out, have = one, 1
        for bit in bin(length)[3:]:
            power = U64(pow(base, have, 1 << 64))
            out, have = out[:-have] * power + out[have:], 2 * have
            if bit == "1":
                out, have = out[:-1] * U64(base) + one[have:], have + 1
        return mix(out)


def least_places(keys: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` keys the place of the least, the first of equals; by doubling too."""
    low, at, have = keys, np.arange(len(keys)), 1
    while have < width:
        step = min(have, width - have)
        right = low[step:] < low[:-step]
        low, at = np.where(right, low[step:], low[:-step]), np.where(right, at[step:], at[:-step])
        have += step
    return at


def _chunks(batch: pa.RecordBatch, known: WordCodes) -> Iterator[tuple[int, list, np.ndarray, np.ndarray]]:
    """Runs of rows of about CHUNK_WORDS words: (first row, words of each, codes, bounds of each)."""
    texts = batch.column("text")
    first, lists, total = 0, [], 0
    for i in range(batch.num_rows):
        lists.append(split_words(texts[i].as_py()))
        total += len(lists[-1])
        if total >= CHUNK_WORDS or i == batch.num_rows - 1:
            bounds = np.cumsum([0, *map(len, lists)])
            yield first, lists, code_words([w for x in lists for w in x], known), bounds
            first, lists, total = i + 1, [], 0


def _inside(bounds: np.ndarray, length: int) -> np.ndarray:
    """Places where a window of `length` words starts and lies within one document."""
    sizes = np.diff(bounds)
    starts = np.repeat(bounds[1:], sizes)
    return np.flatnonzero(np.arange(bounds[-1]) + length <= starts)


def _picks(codes: np.ndarray, bounds: np.ndarray, small: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the windows of `length` words, the place of the small window that stands for each, all hashes."""
    starts = _inside(bounds, length)
    if not len(starts):
        return starts, starts, np.empty(0, U64)
    hashes = window_hashes(codes, small)
    return starts, least_places(hashes, length - small + 1)[starts], hashes


def _rows_of(places: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many of the sorted places each document has, as offsets."""
    return np.searchsorted(places, bounds).astype(np.int32)


def _first_level(small: int, length: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordCodes()
        for batch in batches:
            for first, lists, codes, bounds in _chunks(batch, known):
                _, picked, hashes = _picks(codes, bounds, small, length)
                places = np.unique(picked)
                offsets = _rows_of(places, bounds)
                own = np.repeat(bounds[:-1], np.diff(offsets))
                data = [codes[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays([
                    *[batch.column(c).slice(first, len(lists)) for c in ("doc_id", "id", "key")],
                    pa.array(np.diff(bounds), pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in data], pa.binary()),
                    pa.array([hashlib.sha256(b" ".join(x)).hexdigest() for x in lists], pa.string()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array((places - own).astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes[places].view(np.int64))),
                ], ["doc_id", "id", "key", "n_words", "whole", "sha256", "places", "hashes"])

    return each


def _second_level(small: int, length: int):
    """Hashes of the windows of `length` words that a repeated small window stands for."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordCodes()
        for batch in batches:
            for first, lists, codes, bounds in _chunks(batch, known):
                starts, picked, _ = _picks(codes, bounds, small, length)
                if not len(starts):
                    continue
                flags = _flags(batch.column("places").slice(first, len(lists)), bounds)
                yield _windows(batch, first, codes, bounds, starts[flags[picked]], length)

    return each


def _next_level(length: int, twice: int):
    """Hashes of the windows of `twice` words whose two halves of `length` words repeat."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordCodes()
        for batch in batches:
            for first, lists, codes, bounds in _chunks(batch, known):
                starts = _inside(bounds, twice)
                flags = _flags(batch.column("places").slice(first, len(lists)), bounds)
                starts = starts[flags[starts] & flags[starts + (twice - length)]]
                if len(starts):
                    yield _windows(batch, first, codes, bounds, starts, twice)

    return each


def _flags(places: pa.Array, bounds: np.ndarray) -> np.ndarray:
    out = np.zeros(bounds[-1], bool)
    at = places.flatten().to_numpy(zero_copy_only=False)
    lengths = np.diff(places.offsets.to_numpy())
    out[at + np.repeat(bounds[:-1], lengths)] = True
    return out


def _windows(batch: pa.RecordBatch, first: int, codes: np.ndarray, bounds: np.ndarray, starts: np.ndarray, length: int) -> pa.RecordBatch:
    row = np.searchsorted(bounds, starts, side="right") - 1
    ids, keys = (batch.column(c).to_numpy(zero_copy_only=False)[first + row] for c in ("id", "key"))
    a = window_hashes(codes, length)[starts].view(np.int64)
    b = (window_hashes(codes, length, 1)[starts] >> U64(32)).astype(np.uint32).view(np.int32)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids), pa.array(keys), pa.array((starts - bounds[row]).astype(np.int32)), pa.array(a), pa.array(b)],
        ["id", "key", "at", "a", "b"],
    )


def _cut(length: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, shas, spans = [], [], []
            for text, starts in zip(batch.column("text"), batch.column("starts")):
                words = split_words(text.as_py())
                step = np.zeros(len(words) + 1, np.int32)
                at = starts.values.to_numpy(zero_copy_only=False)
                np.add.at(step, at, 1)
                np.add.at(step, at + length, -1)
                gone = np.cumsum(step[:-1]) > 0
                edges = np.flatnonzero(np.diff(np.concatenate(([0], gone, [0]))))
                removed.append(int(gone.sum()))
                shas.append(hashlib.sha256(b" ".join(compress(words, ~gone))).hexdigest())
                spans.append([{"begin": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2])])
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), batch.column("key"), pa.array(removed, pa.int64()), pa.array(shas, pa.string()),
                pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))),
            ], ["id", "key", "n_removed", "cut_sha256", "spans"])

    return each


@scratch
def repeated_words(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """Per row of `docs`: doc_id, n_words, n_removed, spans (begin, end) of the words to remove, kept_sha256.

    A word goes if a window of `min_words` words covers it whose words also start, in the same order, in a
    document with a smaller doc_id. kept_sha256 is of the other words, joined by one space.

    1. Documents with equal words throughout are copies: all but the least doc_id lose everything (if they
       have a window at all) and take no further part.
    2. First level, half of `min_words`: of the small windows inside each full window the one of least hash
       stands for it. Equal full windows have equal ones. Those hashes are counted over all
       documents; a full window whose small window is in one document only cannot repeat.
    3. The others are extended to twice the length and matched again, level by level up to
       `min_words`, or until no candidate is left. Above the first level a window is a
       candidate if both its halves repeat. A level's table holds 96 bits per window and its least document.

    Tables of hashes hold only what is in two documents or more; they are aggregated before the shuffle and
    written, and the join against them is split by adaptive execution, so a passage that a third of all
    documents share is no task of its own.

    A null or empty text has no words. A row without doc_id comes after all others. Rows with equal doc_id
    are the same document as far as "smaller" goes: they never remove from each other. Other
    columns are dropped. An empty table gives no rows.
    """
    lengths = levels(min_words)
    text = F.col("text").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)).alias("id"),
        F.hash(text).alias("key"), text.alias("text"),
    )
    level = staged(rows.mapInArrow(
        _first_level(lengths[0], (lengths[1:] or lengths)[0]),
        "doc_id bigint, id bigint, key int, n_words bigint, whole binary, sha256 string, places array<int>, hashes array<bigint>",
    ), "level")
    owners = level.filter(F.col("n_words") >= min_words).groupBy("whole").agg(F.min("id").alias("owner"))
    owners = staged(owners, "owners", keep=True)

    first = level.select("id", "key", "whole", "places", "hashes").join(owners, "whole").filter("id = owner")
    prints = first.select("id", "key", F.explode(F.arrays_zip("places", "hashes")).alias("p"))
    hits = _matched(staged(prints.select("id", "key", F.col("p.places").alias("at"), F.col("p.hashes").alias("a")), "prints"), ["a"])
    texts = rows.select("id", "key", "text")
    for n, length in enumerate(lengths[1:] or lengths):
        texts = staged(texts.join(_places(hits), ["id", "key"]), "texts")
        step = _second_level(lengths[0], length) if n == 0 else _next_level(lengths[n], length)
        windows = texts.mapInArrow(step, "id bigint, key int, at int, a bigint, b int")
        hits = _matched(staged(windows, "windows"), ["a", "b"])
        texts = texts.drop("places")
    starts = _places(hits.filter("id > least")).withColumnRenamed("places", "starts")
    cut = texts.join(starts, ["id", "key"]).mapInArrow(
        _cut(min_words), "id bigint, key int, n_removed bigint, cut_sha256 string, spans array<struct<begin:bigint,end:bigint>>"
    )
    cut = staged(cut, "cut", keep=True).dropDuplicates(["id", "key"])

    told = staged(level.select("doc_id", "id", "key", "n_words", "whole", "sha256"), "told", keep=True)
    out = told.join(owners, "whole", "left").join(cut, ["id", "key"], "left")
    copy = F.coalesce(F.col("id") > F.col("owner"), F.lit(False))
    none, zero = F.array().cast("array<struct<begin:bigint,end:bigint>>"), F.lit(0).cast("bigint")
    return out.select(
        "doc_id", "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
        F.when(copy, F.array(F.struct(zero.alias("begin"), F.col("n_words").alias("end")))).otherwise(F.coalesce("spans", none)).alias("spans"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("cut_sha256", "sha256")).alias("kept_sha256"),
    )


def _matched(rows: DataFrame, key: list[str]) -> DataFrame:
    """The rows whose key is in two documents or more, with the least of those."""
    ends = rows.groupBy(*key).agg(F.min("id").alias("least"), F.max("id").alias("most"))
    return rows.join(staged(ends.filter("least < most").select(*key, "least"), "seen"), key)


def _places(hits: DataFrame) -> DataFrame:
    """The places of each document's hits; no more than it has words."""
    return staged(hits.groupBy("id", "key").agg(F.collect_list("at").alias("places")), "places")
