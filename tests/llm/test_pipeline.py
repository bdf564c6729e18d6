"""The stages one by one, and the whole run."""

import random

import corpus_pipeline
from conftest import SF
from test_lines import brute_words as lines_brute
from test_near_duplicates import brute as near_brute
from test_packing import check

from spendtide.llm import mixing, packing, quality
from spendtide.llm.common import staged, table


def test_stages_on_the_smallest_tables(spark):
    """Each stage against the brute form of its operator, on what the stage before has kept."""
    docs = table(spark, SF, "documents")
    kept = [staged(docs)]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = staged(stage(spark, kept[-1], SF))
        assert out.columns == docs.columns
        kept.append(out)
    raw, good, lined, single, mixed = kept

    judged = {r.doc_id: r for r in quality.judge(raw, with_text=True).collect()}
    assert {r.doc_id: r.text for r in good.collect()} == {i: r.clean_text for i, r in judged.items() if r.kept}

    rows = [(r.doc_id, r.text) for r in good.collect()]
    want = {d: t for d, n, gone, t in lines_brute(rows, 3, 50) if not gone or gone < n}
    assert {r.doc_id: r.text for r in lined.collect()} == want

    rows = [(r.doc_id, r.text) for r in lined.collect()]
    want = {d for d, _, _, stays in near_brute(rows, 5) if stays}
    assert {r.doc_id for r in single.collect()} == want

    assert sorted(map(str, mixed.collect())) == sorted(map(str, single.collect()))

    packed = corpus_pipeline.STAGES[-1][1](spark, mixed, SF).collect()
    assert {r.doc_id for r in packed} == want
    n = check(packed, 2048)
    assert n <= -(-sum(r.length for r in packed) // 2048) + 1


def test_run_and_odd_tables(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept int, `slot_` string, `row_` string"
    body = " ".join(f"w{i}" for i in range(90))
    rows = [(1, None), (2, ""), (None, body), (3, body + " x"), (3, body + " x"), (4, "\n".join(f"{body} {i}" for i in range(4)))]
    for n, part in (("some", rows), ("none", [])):
        df = spark.createDataFrame([(d, t, None, None, None, 1, "s", "r") for d, t in part], schema)
        df.write.parquet(str(tmp_path / n / "documents.parquet"))
        out = corpus_pipeline.run(spark, str(tmp_path / n))
        assert {r.doc_id for r in out.collect()} == ({None, 3} if part else set())  # 4 repeats itself


def test_sequences_follow_the_mix(spark, monkeypatch):
    """Every prefix of the packed sequences holds the target weights while no source is used up."""
    monkeypatch.setattr(packing, "ITEMS_PER_TASK", 1500)
    rng = random.Random(3)
    sources = {"src0": 4, "src1": 2, "other": 1}
    names = list(sources)
    rows = [(i, " ".join(f"w{rng.randrange(1000)}" for _ in range(rng.randrange(40, 200))), names[i % 3]) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(5)
    packed = corpus_pipeline.best_fit_packing(spark, corpus_pipeline.source_mixing(spark, docs, SF), SF).collect()
    assert check(packed, 2048) <= sum(r.length for r in packed) / 2048 * 1.01 + 1
    of = {i: s for i, _, s in rows}
    left, given, by = dict.fromkeys(sources, 0), dict.fromkeys(sources, 0), {}
    for r in packed:
        left[of[r.doc_id]] += r.length
        by.setdefault(r.sequence_id, []).append(r)
    block = max(left.values()) * mixing.BLOCK_BYTES / sum(len(t) + 1 for _, t, s in rows if s == "src0")
    near = packing.WINDOW * sum(r.length for r in packed) / len(packed)
    checked = 0
    for s in sorted(by):
        for r in by[s]:
            given[of[r.doc_id]] += r.length
        if given["src0"] > left["src0"] - block - near:
            break
        checked += 1
        total = sum(given.values())
        # A block from its share, as the mix itself, and what best fit moves within a window.
        assert all(abs(given[x] - total * w / 7) < block + near / 2 for x, w in sources.items())
    assert checked > len(by) / 4
