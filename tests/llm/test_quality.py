"""Quality rules on hand-made texts and against a plain form."""

import random

import pytest

import corpus_pipeline
from spendtide.llm import quality

DOC = "doc_id bigint, text string, source string"
SPACE = " \t\n\x0b\x0c\r"


def plain(text):
    words = [w for w in _split(text or "")]
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in (text or "").split("\n") if _split(x)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered),
    )


def _split(text):
    for c in SPACE:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def judged(spark, rows, schema=DOC):
    return {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, schema)).collect()}


def test_counts_against_a_plain_form(spark):
    rng = random.Random(4)
    texts = [
        "".join(rng.choice(["a", "b", "cc ", " d", "\n", "\t", "é ", "# ", "%x", " a b c ", "\xa0"]) for _ in range(rng.randrange(120)))
        for _ in range(300)
    ]
    texts += [None, "", " \n\t", "a a a", "a a a a", "x y z x y z", "\u2028 b\u2028c", "#*$%&|<>", "l\nl\r\nl \nl"]
    got = judged(spark, [(i, t, "s") for i, t in enumerate(texts)])
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain(t), repr(t)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)


def unique(rng, n):
    """Words of letters alone; digits are all alike to the line hash."""
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=9)) for _ in range(n))


def test_frequent_lines_go_and_depleted_documents_with_them(spark):
    rng = random.Random(6)
    menu = " ".join(f"menu{i}" for i in range(60))
    rows = [(i, f"{unique(rng, 60)}\n  MENU {i % 9} home  \n{unique(rng, 60)}", "big") for i in range(40)]
    rows += [(100 + i, f"{menu}\n{unique(rng, 10)}", "big") for i in range(30)]
    rows += [(200 + i, f"{menu}\n{unique(rng, 10)}", "small") for i in range(15)]
    got = judged(spark, rows)
    assert all(got[i].kept and got[i].n_frequent_lines == 1 for i in range(40))
    assert all(got[100 + i].depleted and not got[100 + i].kept for i in range(30))
    assert all(got[200 + i].kept and got[200 + i].n_frequent_lines == 0 for i in range(15))  # 15 documents are few
    cleaned = {r.doc_id: r.text for r in quality.clean(spark.createDataFrame(rows, DOC)).collect()}
    assert set(cleaned) == {*range(40), *range(200, 215)}
    assert len(cleaned[0].split("\n")) == 2 and "MENU" not in cleaned[0] and cleaned[200] == rows[70][1]


def test_copies_are_one_document(spark):
    """A clean document copied many times is not boilerplate."""
    rng = random.Random(8)
    text = "\n".join(unique(rng, 30) for _ in range(4))
    rows = [(i, text, "s") for i in range(300)] + [(1000 + i, unique(rng, 80), "s") for i in range(40)]
    assert all(r.kept for r in judged(spark, rows).values())


def test_odd_rows(spark):
    long = " ".join(str(i) for i in range(100_000))
    rows = [
        (1, None, None), (2, "", ""), (None, "a", "x"), (3, long, None), (3, long, None), (4, "ha " * 200, "s"),
    ]
    df = spark.createDataFrame([(*r, 1, "v", True) for r in rows], DOC + ", n_words int, host_ string, kept boolean")
    out = quality.judge(df).collect()
    assert len(out) == 6
    by = {r.doc_id: r for r in out}
    assert by[3].kept and by[3].n_words == 100_000
    assert [by[i].kept for i in (1, 2, None, 4)] == [False] * 4
    assert by[4].n_repeat_words == 200
    cleaned = quality.clean(df)
    assert cleaned.columns == df.columns and sorted(map(tuple, cleaned.collect())) == [(3, long, None, 1, "v", True)] * 2


def test_empty_table(spark):
    df = spark.createDataFrame([], DOC)
    assert quality.judge(df).count() == 0 and quality.clean(df).count() == 0


@pytest.mark.parametrize("n, failed", [(49, True), (50, False)])
def test_edges_of_the_base_rules(spark, n, failed):
    assert judged(spark, [(1, " ".join(map(str, range(n))), "s")])[1].base_failed is failed
    # 25 of 50 words repeat: not over half
    half = " ".join(["a b c d e"] * 5 + [f"z{i}" for i in range(25)])
    assert judged(spark, [(1, half, "s")])[1].base_failed is False


def test_the_pipeline_finds_boilerplate_in_a_few_percent_of_a_large_host(spark):
    rng = random.Random(5)
    licence = "Copyright %d by the authors, all rights to this text are reserved"
    rows = []
    for i in range(2000):
        text = [unique(rng, 60)]
        text += [licence % i] if i % 33 == 0 else []  # 61 documents, 3 %
        text += ["Read more"] if i % 20 == 0 else []  # 5 %, but short
        text += ["This line is as long as the licence, but few documents hold it"] if i % 100 == 0 else []  # 20 documents
        rows.append((i, "\n".join(text), "large"))
    docs = spark.createDataFrame(rows, DOC)
    cleaned = {r.doc_id: r.text for r in corpus_pipeline.quality_rules(spark, docs, "").collect()}
    assert cleaned == {i: "\n".join(x for x in t.split("\n") if "Copyright" not in x) for i, t, _ in rows}


def test_two_writers_at_once_leave_the_settings_as_they_were(spark):
    from concurrent.futures import ThreadPoolExecutor

    from spendtide.llm.common import WRITING, staged

    before = {k: spark.conf.get(k) for k in WRITING}
    with ThreadPoolExecutor(4) as pool:
        sizes = list(pool.map(lambda i: staged(spark.range(i * 10)).count(), range(8)))
    assert sizes == [i * 10 for i in range(8)] and {k: spark.conf.get(k) for k in WRITING} == before
