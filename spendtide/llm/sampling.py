"""Importance resampling towards a target's word runs, and a distributed radix sort for ranks."""

import math
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendtide.llm.common import scratch, staged
from spendtide.llm.tokens import alnum_words

#: Buckets that features fall into; longest run of words that is a feature.
BUCKETS, RUN = 10_000, 3
#: Words whose checksums a task remembers; beyond it starts afresh.
KNOWN = 300_000
#: Rows that are counted together, and bits of a digit, in a pass of the sort.
CHUNK, DIGIT = 8192, 11

SIGN = -(1 << 63)
# Fixed value: the reflected polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320


def _byte_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(POLYNOMIAL), out >> 1).astype(np.uint32)
    return out


class _Known(dict):
    """Word -> its CRC-32 and, from bit 32 on, its length."""

    def __missing__(self, word: bytes) -> int:
        out = self[word] = zlib.crc32(word) | len(word) << 32
        return out


class Checksums:
    """CRC-32 of runs of words from those of the words: crc(a + b) is crc(a) moved by the length of b, xor crc(b).

    Moving is linear, so a table for each length and byte of the checksum does it for whole arrays.
    """

    def __init__(self):
        self.words = _Known()
        self.step = _byte_table()
        one = np.arange(256, dtype=np.uint32)
        self.tables = np.stack([one, one << 8, one << 16, one << 24])[None].astype(np.uint32)

    def _grow(self, longest: int) -> None:
        tables = list(self.tables)
        while len(tables) <= longest:
            last = tables[-1]
            tables.append((last >> np.uint32(8)) ^ self.step[last & np.uint32(255)])
        self.tables = np.stack(tables)

    def moved(self, crc: np.ndarray, by: np.ndarray) -> np.ndarray:
        """Checksums as if `by` bytes, whose own checksum is added later, followed."""
        t = self.tables
        return t[by, 0, crc & 255] ^ t[by, 1, (crc >> 8) & 255] ^ t[by, 2, (crc >> 16) & 255] ^ t[by, 3, crc >> 24]

    def of_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.words) > KNOWN:
            self.words.clear()
        codes = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        return (codes & np.uint64(0xFFFFFFFF)).astype(np.uint32), (codes >> np.uint64(32)).astype(np.int64)

    def of_runs(self, words: list[bytes], run: int) -> np.ndarray:
        """Of all runs of 1 to `run` neighbouring words, joined by one space."""
        crc, length = self.of_words(words)
        longest = int(length.max(initial=0))
        if longest > 255:  # such words are rare: their runs are put together and read
            return np.array([zlib.crc32(b" ".join(words[i : i + n])) for n in range(1, run + 1) for i in range(len(words) - n + 1)], np.uint32)
        if longest >= len(self.tables):
            self._grow(max(longest, 1))
        space, one = np.uint32(zlib.crc32(b" ")), np.ones(len(words), np.int64)
        out, now = [crc], crc
        for n in range(1, min(run, len(words))):
            now = self.moved(self.moved(now[:-1], one[: len(now) - 1]) ^ space, length[n:]) ^ crc[n:]
            out.append(now)
        return np.concatenate(out)


def buckets_of(text: str | None, checksums: Checksums, buckets: int = BUCKETS, run: int = RUN) -> tuple[int, np.ndarray]:
    """Number of words, and the bucket of every feature."""
    words = alnum_words(text)
    if not words:
        return 0, np.zeros(0, np.int64)
    return len(words), (checksums.of_runs(words, run) % np.uint32(buckets)).astype(np.int64)


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, run: int = RUN) -> DataFrame:
    """(bucket, n): features of the column `text` by bucket, repeats counted; buckets without any are left out."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        checksums, total = Checksums(), np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                total += np.bincount(buckets_of(text.as_py(), checksums, buckets, run)[1], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    parts = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "bucket bigint, n bigint")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log ratio of each bucket's smoothed shares, target to source, in whole thousandths."""
    n = len(source)
    big_s, big_t = float(source.sum() + n), float(target.sum() + n)
    ratio = (target + 1).astype(np.float64) * big_s / ((source + 1).astype(np.float64) * big_t)
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def _scored(gain: np.ndarray, run: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        checksums = Checksums()
        for batch in batches:
            out = []
            for text in batch.column("text"):
                n, found = buckets_of(text.as_py(), checksums, len(gain), run)
                out.append((n, len(found), int(gain[found].sum())))
            columns = [pa.array([r[i] for r in out], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_words", "n_features", "weight"])

    return each


def noise(doc_id: Column, seed: str) -> Column:
    """Gumbel noise in whole thousandths, from a hash of seed and id; a null id hashes as an empty text."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h.cast("double") + 0.5) / 4294967296.0))).cast("bigint")


# ---- ranks ------------------------------------------------------------------------------


def _unsigned(c: Column, descending: bool) -> Column:
    """A number whose bits, unsigned, stand in the wanted order. Null has none."""
    flipped = c.cast("bigint").bitwiseXOR(F.lit(SIGN))
    return F.bitwise_not(flipped) if descending else flipped


def _pieces(rows: DataFrame, keys: Sequence[tuple[str, bool]]) -> list[tuple[Column, int]]:
    """What of the keys differs among the rows, least significant first: (value, bits) of at most DIGIT bits each.

    Bits that all rows share order nothing and make no digit. One row of extents reaches the driver.
    """
    asked = []
    for name, descending in keys:
        u = _unsigned(F.col(name), descending)
        asked += [F.bit_or(u), F.bit_and(u), F.count_if(F.col(name).isNull())]
    seen = rows.agg(*[c.alias(f"x{i}") for i, c in enumerate(asked)]).first()
    out = []
    for i in reversed(range(len(keys))):
        u = F.coalesce(_unsigned(F.col(keys[i][0]), keys[i][1]), F.lit(0).cast("bigint"))
        any_, all_, nulls = seen[3 * i : 3 * i + 3]
        differ = ((any_ or 0) ^ (all_ or 0)) & ((1 << 64) - 1)
        low, high = (differ & -differ).bit_length() - 1, differ.bit_length()
        if nulls:
            low = 0 if not differ else low
        while differ and low < high:
            n = min(DIGIT, high - low)
            out.append((F.shiftrightunsigned(u, low).bitwiseAND(F.lit((1 << n) - 1)), n))
            low += n
        if nulls:  # behind all others
            out.append((F.col(keys[i][0]).isNull().cast("bigint"), 1))
    return out


def _digits(pieces: list[tuple[Column, int]]) -> list[Column]:
    """Composite digits: neighbouring pieces, of whatever keys, share a digit as far as DIGIT bits go."""
    out: list[Column] = []
    now, bits = None, 0
    for value, n in pieces:
        if now is not None and bits + n <= DIGIT:
            now, bits = now.bitwiseOR(F.shiftleft(value, bits)), bits + n
        else:
            if now is not None:
                out.append(now)
            now, bits = value, n
    return out if now is None else [*out, now]


def _place(rows: pa.Table, offsets: pa.Table) -> pa.Table:
    """The rows of one chunk, at their places by one digit: equal digits keep their order."""
    digit, at = rows.column("digit_").to_numpy(), rows.column("at_").to_numpy()
    order = np.lexsort((at, digit))
    digit = digit[order]
    first = np.searchsorted(digit, digit, "left")
    names = offsets.column("digit_").to_numpy()
    by = np.argsort(names)
    start = offsets.column("offset_").to_numpy()[by][np.searchsorted(names[by], digit)]
    out = rows.take(pa.array(order))
    return out.set_column(out.schema.get_field_index("at_"), "at_", pa.array(start + np.arange(len(digit)) - first))


def radix_ranked(rows: DataFrame, keys: Sequence[tuple[str, bool]], name: str = "rank") -> DataFrame:
    """`rows` with their rank from 1 by `keys`, (column of whole numbers, whether descending), nulls last: a radix sort.

    Passes go from the least significant digit to the most. In each, rows are counted by chunk of CHUNK neighbours and
    digit; prefix sums over (digit, chunk) give the offset where a chunk's rows of that digit begin; a row's place is that
    offset and the number of such rows before it in its chunk. So each pass is stable, and the places of the last one
    are the ranks. Rows that agree in all keys stand in any order, each with a rank of its own.

    No task holds more than a chunk of rows or the counts of one digit, whatever the keys; hot keys are
    spread over chunks. Offsets are as many rows as there are pairs of chunk and digit at most. `rows` should be narrow:
    every pass writes them.
    """
    pieces = _pieces(rows, keys)
    own = rows.columns
    # Before the first pass a chunk is a slice of a written partition; ids of rows grow along it.
    start = staged(rows.withColumn("at_", F.monotonically_increasing_id()), "unranked")
    chunk = F.floor(F.col("at_") / CHUNK).cast("bigint")
    digits = _digits(pieces) or [F.lit(0).cast("bigint")]
    for i, digit in enumerate(digits):
        cut = start.withColumns({"chunk_": chunk, "digit_": digit})
        counts = staged(cut.groupBy("chunk_", "digit_").agg(F.count("*").alias("n_")), "counts")
        sizes = counts.groupBy("digit_").agg(F.sum("n_").alias("all_"))
        def before(w):
            return w.rowsBetween(Window.unboundedPreceding, -1)

        bases = sizes.select("digit_", F.coalesce(F.sum("all_").over(before(Window.orderBy("digit_"))), F.lit(0)).alias("base_"))
        within = F.coalesce(F.sum("n_").over(before(Window.partitionBy("digit_").orderBy("chunk_"))), F.lit(0))
        offsets = counts.withColumn("within_", within).join(bases, "digit_").select(
            "chunk_", "digit_", (F.col("base_") + F.col("within_")).alias("offset_")
        )
        placed = cut.groupBy("chunk_").cogroup(offsets.groupBy("chunk_")).applyInArrow(_place, cut.schema)
        start = staged(placed.drop("chunk_", "digit_"), "placed", keep=i == len(digits) - 1)
    return start.select(*own, (F.col("at_") + 1).alias(name))


@scratch
def resampled(docs: DataFrame, target: DataFrame, share: int = 5, least_words: int = 20, seed: str = "42", buckets: int = BUCKETS, run: int = RUN) -> DataFrame:
    """(doc_id, n_features, weight, score, rank, n_words): documents drawn without replacement, as if by importance weights.

    Features of a text are its runs of 1 to `run` words (`tokens.alnum_words`), in `buckets` buckets of their CRC-32. A bucket's
    gain is the log ratio of its shares in `target` and `docs`; the weight of a document is the sum over its features, and its
    score adds Gumbel noise, so the highest scores are a sample by weight. Of the documents with `least_words` words the
    `share` in a hundred of highest score are drawn; `rank` is 1 for the first and null for what is not drawn. Ties go to the
    smaller id; a null id comes last.

    A null or empty text has no features, weight 0. Repeated rows are documents of their own. Other columns do not count. Empty `docs`
    give no rows; an empty `target` weighs all buckets by the documents alone. Very long texts are one task's work each, in
    arrays of a few numbers a word.

    Two passes over the texts: one to count buckets (a row per task and bucket at most), one to score. The driver holds
    `buckets` gains. Ranks: `radix_ranked`.
    """
    def counts(df: DataFrame) -> np.ndarray:
        out = np.zeros(buckets, np.int64)
        for r in bucket_counts(df, buckets, run).collect():
            out[r["bucket"]] = r["n"]
        return out

    gain = gains(counts(docs), counts(target))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = texts.mapInArrow(_scored(gain, run), "doc_id bigint, n_words bigint, n_features bigint, weight bigint")
    scored = staged(scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scored", keep=True)
    entitled = F.col("n_words") >= least_words
    drawn = share * scored.filter(entitled).count() // 100
    ranked = radix_ranked(scored.filter(entitled), [("score", True), ("doc_id", False)])
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.filter(~entitled).withColumn("rank", F.lit(None).cast("bigint"))
    return ranked.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank", "n_words")
