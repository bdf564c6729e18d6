"""MinHash near-duplicates against brute force, and on odd input."""

import itertools
import random

import numpy as np
from conftest import SF

from spendtide.llm import minhash
from spendtide.llm.tokens import WordCodes, lowered_words

DOC = "doc_id bigint, text string"


def brute(rows, size, percent=80):
    """{(doc_id, text): (set size, component)} of all pairs."""
    sets = []
    for _, text in rows:
        w = lowered_words(text)
        n = min(size, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return {(d, len(sets[i]), least[find(i)], d == least[find(i)]) for i, (d, _) in enumerate(rows)}


def got(df):
    return {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def family(rng, n, words, edits):
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randrange(edits + 1)):
            copy[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        yield " ".join(copy)


def test_families_of_near_copies(spark):
    rng = random.Random(3)
    texts = [t for words in (30, 60, 200) for t in family(rng, 60, words, words // 8)]
    texts += [" ".join(f"u{rng.randrange(10**6)}" for _ in range(80)) for _ in range(50)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    for size in (2, 5):
        assert got(minhash.near_duplicates(spark.createDataFrame(rows, DOC), size)) == brute(rows, size)


def test_links_that_no_first_document_has(spark, monkeypatch):
    """A chain: neighbours are similar, ends are not, and one list holds them all; in small blocks."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    words = [f"c{i}" for i in range(400)]
    rows = [(100 - k, " ".join(words[k * 9 : k * 9 + 100])) for k in range(30)]
    want = brute(rows, 2)
    assert len({c for _, _, c, _ in want}) == 1
    assert got(minhash.near_duplicates(spark.createDataFrame(rows, DOC), 2)) == want


def test_documents_of_the_smallest_tables(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in df.collect()]
    assert got(minhash.near_duplicates(df, 5)) == brute(rows, 5)


def test_nulls_empty_repeated_and_very_long(spark):
    long = " ".join(f"x{i}" for i in range(60_000))
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "a b"), (7, "A  b\n"), (7, "A  b\n"),
        (None, "a b"), (None, None), (8, long), (9, long + " tail"), (10, "one two"),
    ]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], DOC + ", n_shingles int, component_id string")
    out = minhash.near_duplicates(df, 2).collect()
    assert len(out) == len(rows)
    found = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out}
    assert found == {
        (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True),
        (7, 1, 6, False), (None, 1, None, True), (None, 0, None, True), (8, 59_999, 8, True), (9, 60_000, 8, False),
        (10, 1, 10, True),
    }
    kept = minhash.drop_copies(df, 2)
    assert kept.columns == df.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 2, 3, 4, 6, 8, 10]


def test_empty_table(spark):
    df = spark.createDataFrame([], DOC)
    assert minhash.near_duplicates(df, 5).count() == 0
    assert minhash.drop_copies(df).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    off = []
    for _ in range(200):
        both, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (160, 20, 20))
        one, two = (minhash.signature(np.unique(np.concatenate([both, x]))) for x in (a, b))
        off.append((one == two).sum())
    assert abs(np.mean(off) - 51.2) < 1 and min(off) >= minhash.least_matches(80)


def test_shingles_are_distinct_and_lowered():
    known = WordCodes()
    assert len(minhash.shingles("A b a B a b", 2, known)) == 2
    assert len(minhash.shingles("Ä ä", 2, known)) == 1
    assert len(minhash.shingles("a", 5, known)) == 1
    assert len(minhash.shingles(None, 5, known)) == 0
