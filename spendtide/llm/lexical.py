"""Ranked lexical search: impact lists and the Best Position Algorithm, shard by shard."""

import math
from collections.abc import Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendtide.llm.common import scratch, staged
from spendtide.llm.tokens import alnum_words

#: Queries, and distinct terms of them, that are searched in one pass over the documents.
QUERIES, TERMS = 1000, 100_000
#: Postings of a shard, about; shards of the first wave, as a part of all.
SHARD, FIRST = 1_000_000, 8
#: Positions read at once, at first and at most.
STEP, STRIDE = 16, 512
#: Words other than terms that a task remembers; beyond it starts afresh.
KNOWN = 300_000


class _Vocabulary(dict):
    """Term -> its number; -1 for any other word."""

    def __init__(self, terms: Sequence[bytes]):
        super().__init__((t, i) for i, t in enumerate(terms))
        self.terms = tuple(terms)

    def __missing__(self, word: bytes) -> int:
        if len(self) > KNOWN + len(self.terms):
            self.clear()
            self.update((t, i) for i, t in enumerate(self.terms))
            return self.get(word, -1)
        self[word] = -1
        return -1


def _postings(terms: Sequence[bytes]):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = _Vocabulary(terms)
        for batch in batches:
            n, found, times = [], [], []
            for text in batch.column("text"):
                words = alnum_words(text.as_py())
                codes = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
                t, f = np.unique(codes[codes >= 0], return_counts=True)
                n.append(len(words)), found.append(t), times.append(f)
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *x]), pa.int64())) for x in (found, times)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "t", "f"])

    return each


class Index:
    """The impact lists of one shard, and for direct access each document's row of terms, impacts and positions.

    A list holds its term's documents by descending impact, equal ones by ascending document; documents are numbered
    in the order of their ids, null last.
    """

    def __init__(self, doc_id: pa.Array, n: np.ndarray, ends: np.ndarray, terms: np.ndarray, times: np.ndarray, weights: np.ndarray, all_docs: int, all_terms: int):
        ids = doc_id.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
        self.by_id = np.lexsort((doc_id.is_null().to_numpy(zero_copy_only=False), ids))
        number = np.empty(len(ids), np.int64)
        number[self.by_id] = np.arange(len(ids))
        if 90 * int(n.max(initial=0)) * all_docs < 1 << 63:
            m = 10 + (90 * n * all_docs) // all_terms
        else:
            m = np.array([10 + (90 * int(x) * all_docs) // all_terms for x in n], np.int64)
        of = np.repeat(np.arange(len(ids)), np.diff(ends))
        impact = weights[terms] * ((1_000_000_000 * times) // (1000 * times + 8 * m[of]))
        order = np.lexsort((number[of], -impact, terms))
        self.starts = np.searchsorted(terms[order], np.arange(len(weights) + 1))
        self.row, self.impact, self.ends, self.terms, self.row_impact = of[order], impact[order], ends, terms, impact
        self.number, self.doc_id, self.size = number, doc_id, len(ids)
        self.position = np.empty(len(terms), np.int64)
        self.position[order] = np.arange(len(terms)) - self.starts[terms[order]]
        self.slot = np.full(len(weights), -1)

    def search(self, terms: np.ndarray, k: int, floor: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
        """Rows and scores of the best `k` documents, and how many postings were read.

        Sorted access goes on in the list whose best position has the greatest impact. Every document met is looked up
        in all lists (direct access), which marks its positions as seen there too. A list's best position is the last of those
        seen without a gap from its head: an unseen document is behind it in every list, so the impacts at the best
        positions add up to more than it can score, or as much. Reading stops when that sum is strictly below the k-th score,
        or below `floor`, a score that k documents somewhere are known to have; documents that tie are all met.
        """
        first, after = self.starts[terms], self.starts[terms + 1]
        some = (after > first) & (self.impact[np.minimum(first, len(self.impact) - 1)] > 0) if len(self.impact) else np.zeros(len(terms), bool)
        terms, first, size = terms[some], first[some], (after - first)[some]
        base = np.cumsum(size) - size
        seen, met = np.zeros(int(size.sum()), bool), np.zeros(self.size, bool)
        best, bound = np.zeros(len(terms), np.int64), self.impact[first]
        rows, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.slot[terms] = np.arange(len(terms))
        reads, step = 0, STEP
        while len(terms) and bound.any():
            kth = int(scores[k - 1]) if len(scores) >= k else 0
            if int(bound.sum()) < max(kth, floor):
                break
            i = int(bound.argmax())
            at = first[i] + best[i]
            found = self.row[at : at + min(step, size[i] - best[i])]
            reads, step = reads + len(found), min(2 * step, STRIDE)
            found = found[~met[found]]
            if len(found):
                met[found] = True
                lens = self.ends[found + 1] - self.ends[found]
                entry = np.repeat(self.ends[found] - np.cumsum(lens) + lens, lens) + np.arange(int(lens.sum()))
                slots = self.slot[self.terms[entry]]
                mine = slots >= 0
                entry, slots, whose = entry[mine], slots[mine], np.repeat(np.arange(len(found)), lens)[mine]
                reads += len(entry)
                seen[base[slots] + self.position[entry]] = True
                score = np.zeros(len(found), np.int64)
                np.add.at(score, whose, self.row_impact[entry])
                rows, scores = np.concatenate([rows, found]), np.concatenate([scores, score])
                top = np.lexsort((self.number[rows], -scores))[:k]
                rows, scores = rows[top], scores[top]
            for j in range(len(terms)):
                left = seen[base[j] + best[j] : base[j] + size[j]]
                if len(left) and left[0]:
                    gap = int(left.argmin())
                    best[j] += gap if not left[gap] else len(left)
                    bound[j] = self.impact[first[j] + best[j] - 1] if best[j] < size[j] else 0
        self.slot[terms] = -1
        good = scores > 0
        return rows[good], scores[good], reads


def _searched(queries: list[np.ndarray], weights: np.ndarray, floors: np.ndarray, all_docs: int, all_terms: int, k: int):
    def shard(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        def whole(name):
            return pa.concat_arrays(rows.column(name).chunks)

        t, f = whole("t"), whole("f")
        index = Index(
            whole("doc_id"), whole("n").to_numpy(), t.offsets.to_numpy().astype(np.int64) - t.offsets[0].as_py(),
            t.flatten().to_numpy(), f.flatten().to_numpy(), weights, all_docs, all_terms,
        )
        out = []
        for q, terms in enumerate(queries):
            at, scores, _ = index.search(terms, k, int(floors[q]))
            out.append((np.full(len(at), q), at, scores))
        q, at, scores = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
        return pa.table({"query": pa.array(q, pa.int64()), "doc_id": index.doc_id.take(pa.array(at, pa.int64())), "score": pa.array(scores, pa.int64())})

    return shard


def _ranked(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def _blocks(items: DataFrame) -> Iterator[list[tuple]]:
    """(id, distinct terms) of the queries, in blocks of at most QUERIES; none past TERMS terms begins another query."""
    rows = iter(items.toLocalIterator())
    while block := [(r["item"], sorted(set(alnum_words(r["text"])))) for r in islice(rows, QUERIES)]:
        part, known = [], set()
        for item in block:
            part.append(item)
            known.update(item[1])
            if len(known) > TERMS:
                yield part
                part, known = [], set()
        if part:
            yield part


@scratch
def ranked_search(docs: DataFrame, queries: DataFrame, item: Column, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): for each query the `k` documents of highest score above 0, ties to the smaller id.

    Terms: `tokens.alnum_words` of whole texts. A term that df of N documents hold weighs w = floor(1000 ln((2N + 2) / (2df + 1)));
    where it occurs tf times in a document of n terms it adds w * (10^9 tf div (1000 tf + 8m)), m being 10 + (90 n N div L), L the
    number of all terms. A query's terms count once each.

    1. Queries come to the driver a block at a time (QUERIES, TERMS). A pass over the documents counts the block's terms:
       a row per document with the terms it holds.
    2. Rows are dealt to shards at random, so each has about SHARD postings whatever the terms' frequencies and however many copies
       there are. A task builds the shard's impact lists and searches them for every query by best positions (`Index.search`).
    3. Shards of a first wave, an eighth, give each query a score that k documents reach; the others stop below it.
    4. The k best of each shard are ranked together.

    A null or empty text has no terms: it is found by nothing and, as a query, finds nothing. Repeated documents are found each; repeated
    or null query ids are queries of their own. Documents with a null id come last among equal scores. Other columns do not count. Empty
    tables give no rows. Very long texts: one row of the terms it holds each.
    """
    out = None
    for block in _blocks(queries.select(item.alias("item"), F.col("text").cast("string").alias("text"))):
        found = _search_block(docs, block, k)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], f"item_id {queries.select(item).schema[0].dataType.simpleString()}, rank int, doc_id bigint, score bigint")
    return out.select(F.col("item_id").cast(queries.select(item).schema[0].dataType).alias("item_id"), "rank", "doc_id", "score")


def _search_block(docs: DataFrame, block: list[tuple], k: int) -> DataFrame:
    spark = docs.sparkSession
    terms = sorted({t for _, own in block for t in own})
    number = {t: i for i, t in enumerate(terms)}
    asked = [np.array([number[t] for t in own], np.int64) for _, own in block]
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.mapInArrow(_postings(terms), "doc_id bigint, n bigint, t array<bigint>, f array<bigint>")
    rows = staged(rows.withColumn("row", F.monotonically_increasing_id()), "postings")
    all_docs, all_terms = rows.filter("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(terms), np.int64)
    for r in rows.select(F.explode("t").alias("t")).groupBy("t").count().collect():  # a row per term of the block
        df[r["t"]] = r["count"]
    weights = np.array([math.floor(1000 * math.log((2 * all_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    shards = max(1, -(-int(df.sum()) // SHARD))
    held = rows.filter(F.size("t") > 0).withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)))
    first = -(-shards // FIRST) if shards > 1 else 0
    floors, found = np.zeros(len(block), np.int64), None
    for wave in [F.col("shard") < first, F.col("shard") >= first][first == 0:]:
        search = _searched(asked, weights, floors, all_docs, all_terms, k)
        part = held.filter(wave).select("shard", "doc_id", "n", "t", "f").groupBy("shard").applyInArrow(search, "query bigint, doc_id bigint, score bigint")
        part = staged(part, "found", keep=True)
        if wave is not None and found is None and first:
            for r in _ranked(part, k).filter(F.col("rank") == k).collect():  # one row per query of the block
                floors[r["query"]] = r["score"]
        found = part if found is None else found.unionByName(part)
    names = spark.createDataFrame([(i, None if x is None else str(x)) for i, (x, _) in enumerate(block)], "query bigint, item_id string")
    return _ranked(found, k).join(names, "query").select("item_id", "rank", "doc_id", "score")
