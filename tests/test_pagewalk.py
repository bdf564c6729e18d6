"""Pages in the order of their cursors: whole, broken, circular and doubled chains."""

import random

from pyspark.sql import functions as F

from spendtide.sources import archive, pagewalk

PAGE = "brand string, cursor string, next string, page_index bigint, note string"


def walk(spark, rows):
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(*r, 7, f"{r[1]}>{r[2]}") for r in rows], PAGE).withColumn("state", F.lit("x"))
    pages, report = pagewalk.ordered_pages(df, F.col("next"))
    assert pages.columns == ["brand", "cursor", "next", "note", "page_index", "state"]
    return (
        sorted(((r.brand, r.cursor, r.page_index, r.state) for r in pages.collect()), key=str),
        {r.walk: (r.n_pages, r.n_walked, r.ended, r.missing) for r in report.collect()},
    )


def test_a_long_walk_is_numbered(spark):
    rows = [("a", None if i == 0 else f"c{i}", f"c{i + 1}" if i < 99 else None) for i in range(100)]
    pages, report = walk(spark, rows)
    assert report == {"a": (100, 100, "end", None)}
    assert sorted((p[2], p[1]) for p in pages) == [(i, None if i == 0 else f"c{i}") for i in range(100)]


def test_gaps_cycles_copies_and_missing_starts(spark):
    rows = [
        ("gap", "", "g1"), ("gap", "g1", "g2"), ("gap", "g3", "g4"), ("gap", "g4", None),
        ("loop", None, "l1"), ("loop", "l1", "l2"), ("loop", "l2", "l1"),
        ("self", None, "s"), ("self", "s", "s"),
        ("copy", None, "x"), ("copy", None, "x"), ("copy", "x", ""), ("copy", "x", ""), ("copy", "x", ""),
        ("headless", "h1", "h2"), ("headless", "h2", "h1"),
        ("merge", None, "m2"), ("merge", "m1", "m2"), ("merge", "m2", None),
        (None, None, "n"), (None, "n", None), ("one", None, None), ("other", None, "g3"),
    ]
    pages, report = walk(spark, rows)
    assert report == {
        "gap": (4, 2, "gap", "g2"), "loop": (3, 3, "cycle", None), "self": (2, 2, "cycle", None), "copy": (5, 2, "end", None),
        "headless": (2, 0, "no start", None), "merge": (3, 2, "end", None), None: (2, 2, "end", None), "one": (1, 1, "end", None),
        "other": (1, 1, "gap", "g3"),
    }
    states = {}
    for b, c, i, s in pages:
        states.setdefault((b, c), []).append((i, s))
    assert states["gap", "g3"] == [(None, "unreached")] and states["gap", "g1"] == [(1, "walked")]
    assert sorted(states["copy", "x"], key=str) == [(1, "walked"), (None, "copy"), (None, "copy")]
    assert states["merge", "m1"] == [(None, "unreached")] and states["merge", "m2"] == [(1, "walked")]
    assert states["headless", "h1"] == [(None, "unreached")] and states[None, "n"] == [(1, "walked")]
    assert states["loop", "l2"] == [(2, "walked")]


def test_two_pages_of_one_cursor_with_other_content(spark):
    """One of them stands, the same whatever the order of the rows."""
    rows = [("a", None, "p"), ("a", None, "q"), ("a", "p", None), ("a", "q", "r"), ("a", "r", None)]
    seen = {str(walk(spark, rows[k:] + rows[:k])) for k in range(3)}
    assert len(seen) == 1


def test_no_pages(spark):
    assert walk(spark, []) == ([], {})


def test_ads_of_landed_files_follow_the_cursors(spark, tmp_path):
    lines = [
        '{"brand":"b","cursor":"2","page_index":0,"data":[{"id":"c"}],"paging":{}}',
        '{"brand":"b","page_index":9,"data":[{"id":"a"}],"paging":{"next":"1"}}',
        '{"brand":"b","cursor":"1","data":[{"id":"b"},{"id":"b2"}],"paging":{"next":"2"}}',
        '{"brand":"b","cursor":"zz","data":[{"id":"lost"}],"paging":{"next":"1"}}',
    ]
    (tmp_path / "p.json").write_text("\n".join(lines))
    pages = archive.read_pages(spark, str(tmp_path))
    def ids(n):
        return [r.ad.id for r in archive.explode_ad_pages(pagewalk.walked_pages(pages, n)).orderBy("page_index", "ad.id").collect()]

    assert ids(None) == ["a", "b", "b2", "c"] and ids(2) == ["a", "b", "b2"]


def test_rounds_end_with_the_pages_asked_for(spark, monkeypatch):
    rows = [("a", None if i == 0 else f"c{i}", f"c{i + 1}" if i < 63 else None) for i in range(64)]
    rows += [("loop", None, "l1"), ("loop", "l1", "l2"), ("loop", "l2", "l1"), ("loop", "l2", "l1")]
    pages = spark.createDataFrame(rows, "brand string, cursor string, next string").withColumn("paging", F.struct("next")).drop("next")
    whole = {(r.brand, r.page_index) for r in pagewalk.walked_pages(pages).collect()}
    written = []
    write = pagewalk.Stages.write
    monkeypatch.setattr(pagewalk.Stages, "write", lambda self, df, name="stage", by=None: written.append(name) or write(self, df, name, by))
    for n in (1, 3, 5):
        written.clear()
        got = [(r.brand, r.page_index) for r in pagewalk.walked_pages(pages, n).collect()]
        assert len(got) == len(set(got)) and set(got) == {w for w in whole if w[1] < n}
        assert written.count("reached") == {1: 1, 3: 3, 5: 4}[n]
