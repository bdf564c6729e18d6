"""MinHash near-duplicates by an inverted join over signature coordinates."""

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendtide.llm.common import carried, restored, scratch, staged
from spendtide.llm.tokens import U64, WordCodes, code_words, lowered_words, mix

#: Coordinates of a signature.
COORDINATES = 64
#: Chance that two documents of just the wanted similarity share fewer coordinates than are asked for.
MISS = 1e-7
#: Lists of the prefix that a pair must share, when all of them are short.
SHARED = 4
#: Entries of a list whose pairs are counted one by one; longer lists are matched by first entries and blocks.
SHORT = 12
#: Entries that one block of a long list holds.
BLOCK = 512

_SEEDS = mix(np.arange(1, 2 * COORDINATES + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
_XOR, _MUL = _SEEDS[:COORDINATES], _SEEDS[COORDINATES:] | U64(1)


def least_matches(percent: int) -> int:
    """Coordinates that documents of this similarity share, but for a chance of MISS."""
    p, below, k = percent / 100, 0.0, 0
    while k < COORDINATES:
        below += comb(COORDINATES, k) * p**k * (1 - p) ** (COORDINATES - k)
        if below > MISS:
            break
        k += 1
    return max(k, SHARED)


def shingles(text: str | None, size: int, known: WordCodes) -> np.ndarray:
    """Hashes of the distinct `size`-word shingles, sorted; of all words as one where there are fewer."""
    words = lowered_words(text)
    if not words:
        return np.empty(0, U64)
    codes = code_words(words, known)
    size = min(size, len(codes))
    out = np.zeros(len(codes) - size + 1, U64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = mix(out + codes[k : len(codes) - size + 1 + k])
    return np.unique(out)


def signature(found: np.ndarray) -> np.ndarray:
    """The least 32-bit hash of the set under each of the coordinates' functions."""
    low = np.full(COORDINATES, np.iinfo(U64).max, U64)
    with np.errstate(over="ignore"):
        for at in range(0, len(found), 512):
            part = found[at : at + 512]
            low = np.minimum(low, ((part[None, :] ^ _XOR[:, None]) * _MUL[:, None]).min(axis=1))
    return (low >> U64(32)).astype(np.uint32)


def _sign(size: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordCodes()
        for batch in batches:
            counts, keys, signs = [], [], []
            for text in batch.column("text").to_pylist():
                found = shingles(text, size, known)
                counts.append(len(found))
                keys.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                signs.append(signature(found).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(signs, pa.binary())],
                ["doc_id", "text_hash", "n_shingles", "set_key", "sign"],
            )

    return each


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, set_key, sign) per row; key and signature are null without shingles."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return rows.mapInArrow(_sign(size), "doc_id bigint, text_hash bigint, n_shingles bigint, set_key binary, sign binary")


def _keys(signs: np.ndarray) -> np.ndarray:
    """Of every coordinate and its value, a hash of both."""
    salts = mix(np.arange(COORDINATES, dtype=U64) + U64(1))
    with np.errstate(over="ignore"):
        return mix(signs.astype(U64) + salts[None, :])


def _post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document and coordinate."""
    for batch in batches:
        ids = batch.column("id").to_numpy(zero_copy_only=False)
        signs = np.frombuffer(b"".join(batch.column("sign").to_pylist()), np.uint32).reshape(-1, COORDINATES)
        keys = _keys(signs)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(ids, COORDINATES)), pa.array(keys.view(np.int64).reshape(-1))], ["id", "key"]
        )


def _set_rows(size: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordCodes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingles(t, size, known).tobytes() for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sets, pa.binary())], ["id", "shingles"])

    return each


def _linked(percent: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [
                _similar(np.frombuffer(a.as_buffer(), U64), np.frombuffer(b.as_buffer(), U64), percent)
                for a, b in zip(batch.column("set_a"), batch.column("set_b"))
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b")], ["a", "b"]
            ).filter(pa.array(keep, pa.bool_()))

    return each


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are similar enough."""
    first = sets.select(F.col("id").alias("a"), F.col("shingles").alias("set_a"))
    second = sets.select(F.col("id").alias("b"), F.col("shingles").alias("set_b"))
    both = pairs.join(first, "a").join(second, "b").select("a", "b", "set_a", "set_b")
    return both.mapInArrow(_linked(percent), "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id reachable, for every id that an edge (a, b) names.

    Rounds of hook and jump: a label takes the least label of its neighbours, then the label of
    its label, until nothing changes. Each round is written to the shared folder. Minima are
    aggregated before the shuffle, so an id with very many edges is cheap.
    """
    both = edges.select(F.col("a").alias("id"), F.col("b").alias("to")).unionByName(
        edges.select(F.col("b").alias("id"), F.col("a").alias("to"))
    )
    both = staged(both.distinct(), "edges")
    labels = staged(both.groupBy("id").agg(F.least(F.col("id"), F.min("to")).alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("to"), "component"), "to").select("id", "component")
        least = near.unionByName(labels).groupBy("id").agg(F.min("component").alias("component"))
        least = staged(least, "labels")
        over = least.select(F.col("id").alias("component"), F.col("component").alias("next"))
        jumped = least.join(over, "component", "left").select("id", F.coalesce("next", "component").alias("component"))
        jumped = staged(jumped, "labels")
        old = labels.select("id", F.col("component").alias("old"))
        if jumped.join(old, "id").filter("old != component").isEmpty():
            return jumped
        labels = jumped


def _sizes_fit(a, b, percent: int):
    """Sets of these sizes can be as similar as that."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _match(matches: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, COORDINATES) for c in ("sign_a", "sign_b"))
            keep = (one == two).sum(axis=1) >= matches
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))

    return each


def matching(pairs: DataFrame, entries: DataFrame, matches: int) -> DataFrame:
    """Those of the pairs (a, b) whose signatures agree in enough coordinates: the lists that the prefix skipped count here."""
    first = entries.select(F.col("id").alias("a"), F.col("sign").alias("sign_a"))
    second = entries.select(F.col("id").alias("b"), F.col("sign").alias("sign_b"))
    both = pairs.join(first, "a").join(second, "b").select("a", "b", "sign_a", "sign_b")
    return both.mapInArrow(_match(matches), "a bigint, b bigint").distinct()


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which coordinates of an entry name long prefix lists, as bits."""
    for batch in batches:
        signs = np.frombuffer(b"".join(batch.column("sign").to_pylist()), np.uint32).reshape(-1, COORDINATES)
        named = _keys(signs).view(np.int64)
        out = [np.packbits(np.isin(named[i], k)).tobytes() for i, k in enumerate(batch.column("keys").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("sign"), pa.array(out, pa.binary())], ["id", "sign", "mask"])


def _arrays(block: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    signs = np.frombuffer(b"".join(e["sign"] for e in block), np.uint32).reshape(-1, COORDINATES)
    masks = np.unpackbits(np.frombuffer(b"".join(e["mask"] for e in block), np.uint8).reshape(-1, COORDINATES // 8), axis=1)
    return signs, masks.astype(bool), np.array([e["component"] for e in block], np.int64)


def _meetings(key: int, x: list, y: list | None, matches: int) -> Iterator[tuple[int, list[int]]]:
    """For entries of block x the entries of block y (or later ones of x) in other components that agree in
    enough coordinates, and share no earlier long list than this one. So a pair is met in one list only."""
    signs_x, masks_x, of_x = _arrays(x)
    signs_y, masks_y, of_y = _arrays(y) if y is not None else (signs_x, masks_x, of_x)
    here = int(np.flatnonzero(_keys(signs_x[:1])[0].view(np.int64) == key)[0])
    for i in range(len(x)):
        start = i + 1 if y is None else 0
        same = signs_y[start:] == signs_x[i]
        hit = np.flatnonzero((same.sum(axis=1) >= matches) & (of_y[start:] != of_x[i]))
        if len(hit):
            shared = same[hit] & masks_y[start:][hit] & masks_x[i]
            found = (hit[shared.argmax(axis=1) == here] + start).tolist()
            if found:
                yield i, found


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _involved(matches: int):
    """The entries of a list that meet any other."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            x, y = row["m"], row["other"]
            ids = set()
            for i, found in _meetings(row["key"], x, y, matches):
                ids.add(x[i]["id"])
                ids.update((x if y is None else y)[j]["id"] for j in found)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array([row["key"]] * len(ids), pa.int64()), pa.array(sorted(ids), pa.int64())], ["key", "id"])

    return each


def _compare(matches: int, percent: int):
    """Links between different components of two blocks, or of one, that merge them, confirmed on full sets.

    A pair whose components earlier links of this task have joined is passed over.
    """
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            x, y = row["m"], row["other"]
            z, up, links = x if y is None else y, {}, []

            def root(c: int) -> int:
                while c in up:
                    c = up[c]
                return c

            for i, found in _meetings(row["key"], x, y, matches):
                own = np.frombuffer(x[i]["shingles"], U64)
                for j in found:
                    a, b = root(x[i]["component"]), root(z[j]["component"])
                    if a != b and _similar(own, np.frombuffer(z[j]["shingles"], U64), percent):
                        up[max(a, b)] = min(a, b)
                        links.append((x[i]["id"], z[j]["id"]))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*links)], ["a", "b"])

    return each


def _blocks(held: DataFrame, *fields: str) -> DataFrame:
    """Rows (key, m, other): the blocks of each list that have to be compared, or one with itself (other is null).

    A list is cut into blocks of about BLOCK entries, by size class. A component with more than BLOCK
    entries of a class has blocks of its own, which are not compared with one another; the
    others share blocks. Only blocks of the same or neighbouring classes are compared.
    """
    group = ["key", "class"]
    sizes = held.groupBy(*group, "component").agg(F.count("*").alias("n"))
    sizes = staged(sizes.withColumn("large", F.col("n") > BLOCK), "sizes")
    pooled = sizes.groupBy(*group).agg(F.sum(F.when(~F.col("large"), F.col("n")).otherwise(0)).alias("pooled"))
    sizes = staged(sizes.join(pooled, group), "sizes")
    cut = lambda n: F.ceil(F.greatest(n, F.lit(1)) / BLOCK)
    of = F.when(F.col("large"), F.col("component"))
    part = F.when(F.col("large"), F.pmod(F.xxhash64("id"), cut(F.col("n")))).otherwise(F.pmod(F.xxhash64("component"), cut(F.col("pooled"))))
    entry = F.struct("id", "component", *fields)
    members = held.join(sizes, [*group, "component"]).select(*group, of.alias("of"), part.alias("part"), entry.alias("e"))
    blocks = members.groupBy(*group, "of", "part").agg(F.collect_list("e").alias("m"))
    blocks = staged(blocks.withColumn("block", F.xxhash64("class", "of", "part")), "blocks")

    def name(s: str) -> DataFrame:
        return blocks.select("key", F.col("block").alias(s), F.col("class").alias(f"class_{s}"), F.col("of").alias(f"of_{s}"))

    several = F.col("x") < F.col("y")
    apart = ~F.coalesce(F.col("of_x") == F.col("of_y"), F.lit(False))
    near = F.abs(F.col("class_x") - F.col("class_y")) <= 1
    met = staged(name("x").join(name("y"), "key").filter(several & apart & near).select("key", "x", "y"), "met")
    inner = blocks.filter("of is null").select("key", "m", F.lit(None).cast(blocks.schema["m"].dataType).alias("other"))
    one = blocks.select("key", F.col("block").alias("x"), "m")
    two = blocks.select("key", F.col("block").alias("y"), F.col("m").alias("other"))
    return inner.unionByName(met.join(one, ["key", "x"]).join(two, ["key", "y"]).select("key", "m", "other"))


def _cross_links(held: DataFrame, docs: DataFrame, size: int, matches: int, percent: int) -> DataFrame:
    """Links (a, b) between components that meet in one list: held has id, component, class, key, sign, mask.

    First signatures alone tell which entries meet any other; full sets travel for those only.
    """
    involved = staged(_blocks(held, "sign", "mask").mapInArrow(_involved(matches), "key bigint, id bigint").distinct(), "involved")
    sets = full_sets(docs, involved.select(F.col("id").alias("a"), F.col("id").alias("b")), size)
    whole = held.join(involved, ["key", "id"]).join(sets, "id")
    return _blocks(staged(whole, "whole"), "sign", "mask", "shingles").mapInArrow(_compare(matches, percent), "a bigint, b bigint").distinct()


@scratch
def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, kept) per row of `docs`.

    Documents whose sets of `size`-word shingles have a Jaccard similarity of `percent` or more are
    linked; a component's id is the least doc_id reachable, `kept` is true for that one.

    1. Equal sets are one entry from here on, named by the least doc_id.
    2. Every entry is posted under each (coordinate, value) of its MinHash signature. Lists of one are dropped.
       Two linked entries share T lists (see `least_matches`). Ordered from the rarest, the first
       SHARED of those are in the prefix of both, an entry's lists but for its T - SHARED longest.
       Longer lists are skipped.
    3. Pairs inside short prefix lists are counted; those in SHARED or more are candidates. In a long list every entry is
       paired with the first of its size class. Candidates must agree in T coordinates of the
       signatures, which counts the collisions in the skipped lists, then they are
       confirmed on full sets and joined to components.
    4. Long lists that still hold several components are compared in blocks, inside tasks: pairs of different
       components that agree in T coordinates are confirmed there, and only links that merge components
       leave the task. So no link between different texts is lost, but for MISS, and no group emits its pairs.

    A null or empty text, or one without words, has no shingles and is linked with nothing. A row without
    doc_id is not linked; its component_id is null and it is kept. Repeated rows count as given: rows of one
    doc_id and one text agree, and rows of one doc_id with other texts have components of their own, which
    may carry one id. Other columns are dropped. An empty table gives no rows.
    """
    matches = least_matches(percent)
    signed = staged(signatures(docs, size), "signatures", keep=True)
    usable = signed.filter("set_key is not null and doc_id is not null")
    entries = usable.groupBy("set_key").agg(F.min("doc_id").alias("id"))
    own = usable.select("set_key", F.col("doc_id").alias("id"), F.col("n_shingles").alias("size"), "sign").distinct()
    entries = staged(entries.join(own, ["set_key", "id"]), "entries")

    posts = staged(entries.mapInArrow(_post, "id bigint, key bigint"), "posts")
    lists = posts.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    mine = posts.join(staged(lists, "lists"), "key").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("mine"))
    # Lists of one come first of all and find nothing, so only their number counts.
    length = F.greatest(F.size("mine") - (matches - SHARED), F.lit(0))
    prefix = mine.filter(F.size("mine") >= matches).select("id", F.explode(F.slice("mine", 1, length)).alias("m"))
    sized = entries.select("id", "size", F.floor(F.log(F.col("size")) / F.log(F.lit(100 / percent))).cast("int").alias("class"))
    held = staged(prefix.select("id", "m.key").join(sized, "id"), "held")
    counts = staged(held.groupBy("key").agg(F.count("*").alias("k")).filter("k > 1"), "counts")

    short = held.join(counts.filter(F.col("k") <= SHORT), "key").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("id", "size"))).alias("e"))
    pairs = short.select(F.explode("e").alias("x"), "e").select("x", F.explode("e").alias("y"))
    pairs = pairs.filter((F.col("x.id") < F.col("y.id")) & _sizes_fit(F.col("x.size"), F.col("y.size"), percent))
    pairs = pairs.groupBy(F.col("x.id").alias("a"), F.col("y.id").alias("b")).agg(F.count("*").alias("n")).filter(F.col("n") >= SHARED)
    long = staged(held.join(counts.filter(F.col("k") > SHORT).select("key"), "key"), "long")
    firsts = long.groupBy("key", "class").agg(F.min_by(F.struct("id", "size"), "id").alias("first"))
    star = long.join(staged(firsts, "firsts"), ["key", "class"]).filter(
        (F.col("first.id") != F.col("id")) & _sizes_fit(F.col("first.size"), F.col("size"), percent)
    ).select(F.col("first.id").alias("a"), F.col("id").alias("b"))
    candidates = staged(pairs.select("a", "b").unionByName(star).distinct(), "pairs")
    candidates = staged(matching(candidates, entries, matches), "candidates")
    found = staged(confirm(candidates, full_sets(docs, candidates, size), percent), "links")
    first = components(found)

    named = long.join(first, "id", "left").withColumn("component", F.coalesce("component", "id"))
    named = staged(named.select("id", "component", "class", "key"), "named")
    mixed = named.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x != y")
    rest = staged(named.join(staged(mixed.select("key"), "mixed"), "key"), "rest")
    final = first
    if not rest.isEmpty():
        keys = long.groupBy("id").agg(F.collect_set("key").alias("keys")).join(rest.select("id").distinct(), "id", "left_semi")
        masked = keys.join(entries.select("id", "sign"), "id").select("id", "sign", "keys").mapInArrow(_masks, "id bigint, sign binary, mask binary")
        marked = staged(rest.join(staged(masked, "masks"), "id"), "marked")
        more = staged(_cross_links(marked, docs, size, matches, percent), "links")
        final = first if more.isEmpty() else components(more.unionByName(found))

    classes = entries.groupBy("set_key").agg(F.min("id").alias("id")).join(final, "id", "left")
    classes = staged(classes.select("set_key", F.coalesce("component", "id").alias("component")), "classes", keep=True)
    out = signed.join(classes, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "text_hash", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def full_sets(docs: DataFrame, pairs: DataFrame, size: int) -> DataFrame:
    """(id, shingles) of the documents that the pairs name, from whole texts."""
    needed = staged(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "needed")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").cast("string").alias("text"))
    return staged(texts.join(needed, "id", "left_semi").mapInArrow(_set_rows(size), "id bigint, shingles binary"), "sets")


@scratch
def drop_copies(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component, the one of least doc_id; the columns of `docs`.

    Rows that repeat a doc_id and its text are one document: all or none of them stay.
    """
    gone = near_duplicates(docs, size, percent).filter("not kept").select("doc_id", "text_hash").distinct()
    text = F.col("text").cast("string")
    rows = carried(docs, doc_id=F.col("doc_id").cast("bigint"), text_hash=F.xxhash64(text))
    # The removed grow with the documents, so they are not broadcast, also where they are still few.
    return restored(rows.join(staged(gone, "gone", keep=True).hint("merge"), ["doc_id", "text_hash"], "left_anti"), docs)
