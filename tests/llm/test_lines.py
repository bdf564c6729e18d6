"""Line dedup against brute force."""

import random

from spendtide.llm import lines

DOC = "doc_id bigint, text string"
SPACES = " \t\n\x0b\x0c\r"


def brute(rows, run=3):
    seen, out = set(), []
    for d, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        every = (text or "").split("\n")
        worded = [i for i, x in enumerate(every) if x.strip(SPACES)]
        norm = [every[i].strip(SPACES) for i in worded]
        gone, mine = set(), set()
        for k in range(len(norm) - run + 1):
            key = tuple(norm[k : k + run])
            if key in seen or key in mine:
                gone |= set(worded[k : k + run])
            mine.add(key)
        seen |= mine
        kept = None if text is None else "\n".join(x for i, x in enumerate(every) if i not in gone)
        out.append((d, len(norm), len(gone), kept))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_lines, r.n_removed, r.text) for r in df.collect()), key=str)


def test_against_brute_force(spark):
    rng = random.Random(11)
    for alphabet in (4, 12, 200):
        rows = []
        for i in range(120):
            text = "\n".join(rng.choice(["", " ", "\t"]) + f"line {rng.randrange(alphabet)}" if rng.random() < 0.9 else "" for _ in range(rng.randrange(25)))
            rows.append((i, text))
        rng.shuffle(rows)
        for run in (2, 3, 5):
            assert got(lines.dedup_lines(spark.createDataFrame(rows, DOC), run)) == brute(rows, run)


def test_first_occurrence_stays_and_the_run_extends(spark):
    a = "\n".join(f"a{i}" for i in range(10))
    rows = [(2, f"x\n{a}\ny"), (1, f"{a}\nz"), (3, "a1\na2\nother\na3\na4")]
    out = {r.doc_id: r for r in lines.dedup_lines(spark.createDataFrame(rows, DOC)).collect()}
    assert out[1].n_removed == 0 and out[2].text == "x\ny" and out[3].n_removed == 0


def test_odd_rows(spark):
    big = "\n".join(f"row {i}" for i in range(30_000))
    run = "p\nq\nr\ns"
    rows = [(1, None), (2, ""), (3, " \n\t\n"), (4, run), (5, "t\n" + run), (None, run), (None, None), (8, big), (9, big + "\nend"), (10, "same\n" * 50)]
    df = spark.createDataFrame([(*r, 5, [1]) for r in rows], DOC + ", n_lines int, starts array<int>")
    assert got(lines.dedup_lines(df)) == brute(rows)
    cleaned = lines.clean(df)
    assert cleaned.columns == df.columns
    assert sorted((r.doc_id or 0, r.n_lines) for r in cleaned.collect()) == [(i, 5) for i in (0, 1, 2, 3, 4, 5, 8, 9, 10)]


def test_repeated_rows_are_one_document(spark):
    rows = [(1, "a\nb\nc"), (1, "a\nb\nc"), (1, "x\na\nb\nc"), (2, "a\nb\nc\nd")]
    out = got(lines.dedup_lines(spark.createDataFrame(rows, DOC)))
    assert out.count((1, 3, 0, "a\nb\nc")) + out.count((1, 3, 3, "")) == 2
    assert len({r for r in out if r[1] == 3}) == 1
    assert (2, 4, 3, "d") in out


def test_empty_table(spark):
    df = spark.createDataFrame([], DOC)
    assert lines.dedup_lines(df).count() == 0 and lines.clean(df).count() == 0


def brute_words(rows, run, words):
    """All runs of lines of every length, each against all places before it."""
    seen, out = set(), []
    for d, text in sorted(rows):
        every = text.split("\n")
        worded = [i for i, x in enumerate(every) if x.strip(SPACES)]
        norm = [every[i].strip(SPACES) for i in worded]
        gone = set()
        for k in range(len(norm)):
            for n in range(1, run + 1):
                part = tuple(norm[k : k + n])
                if len(part) < n or n < run and sum(len(x.split()) for x in part) < words:
                    continue
                if part in seen:
                    gone |= set(worded[k : k + n])
                seen.add(part)
        if 0 < len(norm) < run:
            if ("whole", *norm) in seen:
                gone |= set(worded)
            seen.add(("whole", *norm))
        out.append((d, len(norm), len(gone), "\n".join(x for i, x in enumerate(every) if i not in gone)))
    return sorted(out, key=str)


def test_few_lines_of_many_words(spark):
    rng = random.Random(12)
    pool = [" ".join(rng.choice("abc") + str(k) for _ in range(rng.choice([1, 2, 4, 8]))) for k in range(30)]
    rows = [(i, "\n".join(rng.choice(["", "\t"]) + rng.choice(pool) for _ in range(rng.choice([0, 1, 2, 3, 5, 9])))) for i in range(150)]
    rng.shuffle(rows)
    for run, words in ((3, 6), (2, 8), (4, 9)):
        assert got(lines.dedup_lines(spark.createDataFrame(rows, DOC), run, words)) == brute_words(rows, run, words)


def test_a_long_line_and_copies_of_few_lines_go(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"{long}\nx"), (2, f"y\n {long}\nz"), (3, "short\nlines"), (4, "short\nlines"), (5, "short"), (6, "a\nshort\nb")]
    out = lines.clean(spark.createDataFrame(rows, DOC), words=lines.MIN_WORDS)
    assert {r.doc_id: r.text for r in out.collect()} == {1: rows[0][1], 2: "y\nz", 3: "short\nlines", 5: "short", 6: "a\nshort\nb"}


def test_a_document_of_very_many_lines_takes_time_in_proportion(spark):
    """Two copies of 200,000 lines; the second goes whole."""
    big = "\n".join(f"row {i}" for i in range(200_000))
    df = spark.createDataFrame([(1, big), (2, big + "\nend")], DOC)
    assert [(r.doc_id, r.n_lines, r.n_removed) for r in lines.dedup_lines(df).orderBy("doc_id").collect()] == [(1, 200_000, 0), (2, 200_001, 200_000)]
