"""Best-fit packing of token sequences: packed within partitions, underfull bins merged up a tree."""

import base64
import zlib
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendtide.llm.common import scratch, staged

CAPACITY = 2048
#: Id that ends a document.
END = 0
#: A bin with no more than this left is nearly full and leaves at once.
SLACK = 8
#: Items that one packing task handles, about.
ITEMS_PER_TASK = 100_000
#: A round that lowers the number of underfull bins by less than one in so many is the last.
LEAST_GAIN = 1000
#: Neighbouring items that are packed together first where the order counts, and how much wider each next window is.
WINDOW, WIDER = 512, 8

# Letters up to here are classified alike by all Unicode versions that the two tokenizer libraries know.
_SETTLED = "ɐ"
_SPECIAL = "<|endoftext|>"


@cache
def _tokenizer(vocabulary: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary)


@cache
def _fast(ranks: str):
    """The same vocabulary in a library that is several times as fast on one core."""
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={_SPECIAL: 50256})


def token_ids(text: str, vocabulary: str, ranks: str | None = None) -> list[int]:
    """Ids by the vocabulary file. With `ranks`, texts of settled letters take the faster library; ids are equal.

    That library gives up on runs of some hundred thousand blanks (its pattern looks ahead); those texts take the other.
    """
    if ranks and (text.isascii() or max(text) < _SETTLED):
        try:
            return _fast(ranks).encode(text, allowed_special="all")
        except ValueError:
            pass
    return _tokenizer(vocabulary).encode(text, add_special_tokens=False).ids


def _cut(vocabulary: str, ranks: str | None, capacity: int, keep_ids: bool, also: list[str]):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, piece, start, length, crc, kept = [], [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = np.array([*token_ids(text or "", vocabulary, ranks), END], "<u4")
                first = (len(ids) - 1) % capacity + 1
                for k, (a, b) in enumerate(zip([0, *range(first, len(ids), capacity)], range(first, len(ids) + 1, capacity))):
                    part = ids[a:b]
                    row.append(i), piece.append(k), start.append(a), length.append(b - a), crc.append(zlib.crc32(part.tobytes()))
                    kept.append(part.tobytes() if keep_ids else None)
            columns = {
                "doc_id": batch.column("doc_id").take(pa.array(row, pa.int64())),
                "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()),
                "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()),
            }
            if keep_ids:
                columns["ids"] = pa.array(kept, pa.binary())
            columns |= {c: batch.column(c).take(pa.array(row, pa.int64())) for c in also}
            yield pa.RecordBatch.from_pydict(columns)

    return each


def cut_pieces(docs: DataFrame, vocabulary: str, ranks: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False, also: Sequence[str] = ()) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): documents as token ids, cut only where longer than `capacity`.

    A document's ids end with id 0. The first piece may be shorter, all others are full. `ids` are
    unsigned 32-bit little-endian numbers. A null or empty text is the end id alone. Columns of `docs` named
    in `also` stand behind, the same in each piece of a document.
    """
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * keep_ids
    schema += "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in also)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *also)
    return rows.mapInArrow(_cut(vocabulary, ranks, capacity, keep_ids, list(also)), schema)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of every item, and what each bin holds: largest first, each into the fullest bin that takes it."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    used: list[int] = []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # a bit for each amount of room that some bin has
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = rooms >> size
        if size and fitting:
            left = size + (fitting & -fitting).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                rooms ^= 1 << left
        else:
            left, b = capacity, len(used)
            used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += size
        left -= size
        if left:
            room[left].append(b)
            rooms |= 1 << left
    return bins, offsets, np.array(used, np.int64)


def best_fit_near(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As `best_fit`, but items that stand near each other share a bin; also the least item of every bin, ascending.

    Windows of WINDOW neighbours are packed apart; bins left underfull are the items of windows WIDER times as wide.
    """
    home, offsets, used = np.arange(len(sizes)), np.zeros(len(sizes), np.int64), np.array(sizes, np.int64)
    live, window = home.copy(), WINDOW
    while True:
        into, shift = np.arange(len(sizes)), np.zeros(len(sizes), np.int64)
        leads = []
        for a in range(0, len(live), window):
            near = live[a : a + window]
            bins, at, held = best_fit(used[near], capacity)
            lead = np.full(len(held), len(sizes))
            np.minimum.at(lead, bins, near)
            into[near], shift[near] = lead[bins], at
            used[lead] = held
            leads.append(lead)
        offsets += shift[home]
        home = into[home]
        if len(live) <= window:
            break
        live = np.sort(np.concatenate(leads))
        live = live[used[live] < capacity - SLACK]
        window *= WIDER
    least, bins = np.unique(home, return_inverse=True)
    return bins, offsets, used[least], least


def _merge(capacity: int, level: int, last: bool, ordered: bool):
    """One task's round: its bins are the items; a piece moves with its bin."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        old = table.column("bin").to_numpy()
        held = table.column("held").to_numpy()
        inner = table.column("offset").to_numpy()
        names, first, item = np.unique(old, return_index=True, return_inverse=True)
        if ordered:
            bins, offsets, used, least = best_fit_near(held[first], capacity)
        else:
            bins, offsets, used = best_fit(held[first], capacity)
        open_ = (used < capacity - SLACK) & (not last)
        mine = bins[item]
        if ordered:
            name = names[least[mine]]
        else:
            name = (np.int64(level) << np.int64(56)) + (np.int64(TaskContext.get().partitionId()) << np.int64(32)) + mine
        for name_, values in (("bin", name), ("held", used[mine]), ("offset", offsets[item] + inner), ("open", open_[mine])):
            values = pa.array(values)
            table = table.set_column(table.schema.get_field_index(name_), name_, values) if name_ in table.schema.names else table.append_column(name_, values)
        yield from table.to_batches()

    return each


@scratch
def pack(pieces: DataFrame, capacity: int = CAPACITY, order: Sequence[str] = ()) -> DataFrame:
    """`pieces` with sequence_id and offset: as few sequences of at most `capacity` as best fit finds.

    1. Pieces are dealt to tasks and packed there by best fit, largest first.
    2. Bins with at most SLACK left are sequences. Underfull bins become the items of the next round, in
       a task for every ITEMS_PER_TASK, and are packed by best fit again.
    3. This repeats up the tree, each round with all underfull bins, until one task takes all that is left or a round
       has merged fewer than one bin in LEAST_GAIN: what is left then is sequences as it is (bins over half full, say,
       of which no two fit together). No task ever takes more than ITEMS_PER_TASK bins, about.

    Every round is written to the shared folder. A piece travels with its bin's name, what the bin
    holds and its offset there, so no join puts sequences together. `length` over `capacity` is an
    error. Repeated rows are pieces of their own. An empty table gives no rows.

    With `order`, columns of `pieces`, the sequences follow it: pieces are numbered in that order, a task takes a
    range of them, neighbours are packed first (`best_fit_near`), and sequence_id is the number of the sequence's
    first piece. So the sequences up to any one hold all pieces up to its first, and what best fit put beside them.
    """
    too_long = F.raise_error(F.lit("a piece is longer than a sequence"))
    items = pieces.withColumns({
        "held": F.when(F.col("length") > capacity, too_long.cast("bigint")).otherwise(F.col("length")),
        "offset": F.lit(0).cast("bigint"), "bin": F.monotonically_increasing_id(), "open": F.lit(True),
    })
    items = staged(items, "pieces")
    if order:
        items = staged(items.orderBy(*order).withColumn("bin", F.monotonically_increasing_id()), "ordered")
    done, level = None, 0
    count = items.count()
    while True:
        level += 1
        parts = max(1, -(-count // ITEMS_PER_TASK))
        dealt = items.repartitionByRange(parts, "bin") if order else items.repartition(parts, "bin")
        packed = staged(dealt.mapInArrow(_merge(capacity, level, parts == 1, bool(order)), items.schema), "packed", keep=True)
        closed = packed.filter("not open")
        done = closed if done is None else done.unionByName(closed)
        if parts == 1:
            break
        items, before = packed.filter("open"), count
        count = items.select("bin").distinct().count()
        if before - count < before / LEAST_GAIN:
            done = done.unionByName(items)
            break
    return done.select(*pieces.columns, F.col("bin").alias("sequence_id"), "offset")


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences, from placed pieces that carry their ids."""
    parts = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    join = F.aggregate("p", F.lit(b"").cast("binary"), lambda out, x: F.concat(out, x["ids"]))
    return parts.select("sequence_id", join.alias("ids"))
