"""Line dedup: winnowed line hashes find places that may match, matches are extended, later runs go."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendtide.llm.common import GAP, SPACES, carried, has_word, let, restored, scratch, staged

#: Lines in a row that make a run. Also the winnowing window, so that no run of this length is missed.
MIN_LINES = 3
#: Words in neighbouring lines that make a run too where the caller asks for it, however few the lines are.
MIN_WORDS = 50
LAST = (1 << 63) - 1


def _worded(text: Column) -> Column:
    """The lines that hold a word, without white space at their ends."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), has_word)
    return F.transform(lines, lambda line: F.btrim(line, F.lit(SPACES)))


def _hashes(text: Column) -> Column:
    return F.transform(_worded(text), lambda line: F.xxhash64(line))


def _n_words(text: Column) -> Column:
    return F.transform(_worded(text), lambda line: F.size(F.split(line, GAP)))


def _starts(h: Column, run: int) -> Column:
    return F.when(F.size(h) >= run, F.sequence(F.lit(0), F.size(h) - run)).otherwise(F.array().cast("array<int>"))


def _pick(h: Column, i: Column, run: int) -> Column:
    """Place of the least hash among the window's lines, the first at a tie."""
    window = F.slice(h, i + 1, run)
    return (i + F.array_position(window, F.array_min(window)) - 1).cast("int")


def _fingerprints(h: Column, run: int) -> Column:
    """Every fingerprint once: its place, and the first and last window that it is the fingerprint of.

    A later window has no earlier fingerprint, so the windows of one are neighbours; all of it takes time in proportion to the lines.
    """
    def cut(picks: Column) -> Column:
        fresh = F.filter(F.sequence(F.lit(0), F.size(picks) - 1), lambda i: (i == 0) | (F.get(picks, i) != F.get(picks, i - 1)))
        return let(fresh, lambda f: F.transform(f, lambda i, k: F.struct(
            F.get(picks, i).alias("at"), i.alias("lo"), (F.coalesce(F.get(f, k + 1), F.size(picks)) - 1).alias("hi"))))

    none = F.array().cast("array<struct<at:int,lo:int,hi:int>>")
    return F.when(F.size(h) >= run, let(F.transform(_starts(h, run), lambda i: _pick(h, i, run)), cut)).otherwise(none)


def _few_lines(key: Callable[..., Column], run: int, words: int) -> Column:
    """Windows of under `run` lines that have `words` words, and the whole of a document that has under `run` lines."""
    def window(n: int, seed: int) -> Callable[[Column], Column]:
        return lambda i: F.struct(i.cast("int").alias("at"), F.lit(n).alias("n"), key(i, seed, n).alias("a"), key(i, seed + 1, n).alias("b"))

    def long(n: int) -> Callable[[Column], Column]:
        return lambda i: F.aggregate(F.slice("c_", i + 1, n), F.lit(0), lambda a, x: a + x) >= words

    none = F.array().cast("array<struct<at:int,n:int,a:bigint,b:bigint>>")
    parts = [none]
    for n in range(1, run):
        parts.append(F.transform(F.filter(_starts(F.col("h_"), n), long(n)), window(n, 1)))
        parts.append(F.when(F.size("h_") == n, F.array(window(n, 3)(F.lit(0)))).otherwise(none))
    return F.concat(*parts)


@scratch
def later_runs(docs: DataFrame, run: int = MIN_LINES, words: int | None = None) -> DataFrame:
    """(id_, text_, starts): where in a document runs of `run` lines begin that occurred before, and their lines.

    "Before" is the order of (doc_id, text hash, place), documents without id last. Lines are
    compared without white space at their ends; lines without a word do not count, nor break a run.

    1. Winnowing: of each window of `run` line hashes the least is a fingerprint. Equal runs have equal
       fingerprints, and far fewer places than lines are posted.
    2. Fingerprints that occur once are gone. At the places of the others the window around is read:
       all windows whose fingerprint this is, up to `run` - 1 lines to either side.
    3. Such windows are joined with their first occurrence (pre-aggregated, two hashes of 64 bits);
       each one but the first is a later repeat. Overlapping windows make up the whole extended run.

    A window's hash that a third of all rows share is one row in the table of firsts; the other
    side of that join is split by adaptive execution.

    With `words`, so are runs of fewer lines that have as many words, and all lines of a document that has fewer than
    `run` (compared with other whole documents): such windows are joined with their first occurrence as they are.
    """
    lines = docs.select(
        F.coalesce(F.col("doc_id"), F.lit(LAST)).alias("id_"), F.xxhash64("text").alias("text_"),
        _hashes(F.col("text")).alias("h_"), *([_n_words(F.col("text")).alias("c_")] if words else []),
    ).filter(F.size("h_") >= (1 if words else run))
    lines = staged(lines.distinct(), "lines")
    posted = lines.select("id_", "text_", F.explode(_fingerprints(F.col("h_"), run)).alias("f_"), "h_")
    posted = staged(posted.select("id_", "text_", "f_.lo", "f_.hi", F.get("h_", F.col("f_.at")).alias("print_")), "prints")
    shared = staged(posted.groupBy("print_").agg(F.count("*").alias("n_")).filter("n_ > 1").select("print_"), "shared")
    places = posted.join(shared, "print_").groupBy("id_", "text_").agg(F.collect_list(F.struct("lo", "hi")).alias("places"))

    def key(i: Column, seed: int, n: int = run) -> Column:
        return F.xxhash64(F.lit(seed), F.slice("h_", i + 1, n))

    starts = F.flatten(F.transform("places", lambda r: F.sequence(r["lo"], r["hi"])))
    windows = lines.join(places, ["id_", "text_"]).select("id_", "text_", F.explode(F.transform(starts, lambda i: F.struct(
        i.cast("int").alias("at"), F.lit(run).alias("n"), key(i, 1).alias("a"), key(i, 2).alias("b")))).alias("w"))
    windows = windows.select("id_", "text_", "w.at", "w.n", "w.a", "w.b")
    if words:
        few = lines.select("id_", "text_", F.explode(_few_lines(key, run, words)).alias("w"))
        windows = windows.unionByName(few.select("id_", "text_", "w.at", "w.n", "w.a", "w.b"))
    windows = staged(windows, "windows")
    place = F.struct("id_", "text_", "at")
    firsts = windows.groupBy("a", "b").agg(F.min(place).alias("first_"), F.count("*").alias("n_")).filter("n_ > 1")
    firsts = staged(firsts.select("a", "b", "first_"), "firsts")
    later = windows.join(firsts, ["a", "b"]).filter(place > F.col("first_"))
    return staged(later.groupBy("id_", "text_").agg(F.collect_set(F.struct("at", "n")).alias("starts")), "later", keep=True)


def dedup_lines(docs: DataFrame, run: int = MIN_LINES, words: int | None = None) -> DataFrame:
    """`docs` with `text` cut and two more columns: n_lines (that hold a word), n_removed.

    Every line goes that lies in a run of `run` or more lines which also occurs before, in an
    earlier document or earlier in the same one; the first occurrence stays. Judged on the input, not
    on what is left. Other lines keep their bytes and order; lines without a word are never removed.
    With `words`, neighbouring lines of that many words are a run too, however few they are, and so are all
    lines of a document that has fewer than `run`, if an earlier document has just these lines.

    Very long texts: a document is a row, its lines arrays in it; work and memory are in proportion to its lines.
    A null text stays null and has no lines. Rows without doc_id come after all others. Rows
    with equal doc_id and text are one document and get the same result; rows with equal doc_id
    and other texts are documents of their own. An empty table gives no rows. Columns named
    n_lines, n_removed, id_, text_, starts are replaced or dropped.
    """
    found = later_runs(docs, run, words)
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed", "id_", "text_", "starts")]
    keyed = docs.select(*own, F.coalesce(F.col("doc_id"), F.lit(LAST)).alias("id_"), F.xxhash64("text").alias("text_"))

    def cut(lines: Column) -> Column:
        worded = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: has_word(F.get(lines, i)))
        covered = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s["at"], s["at"] + s["n"] - 1))))
        def kept(nb: Column) -> Column:
            gone = F.transform(covered, lambda q: F.get(nb, q))
            rest = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
            return F.struct(
                F.array_join(F.transform(rest, lambda i: F.get(lines, i)), "\n").alias("text"),
                F.size(nb).cast("bigint").alias("n_lines"), F.size(covered).cast("bigint").alias("n_removed"),
            )
        return let(worded, kept)

    plain = F.struct(
        F.col("text"), F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), has_word)).cast("bigint").alias("n_lines"),
        F.lit(0).cast("bigint").alias("n_removed"),
    )
    # Both sides grow with the documents, so neither is broadcast, also where it is still small.
    joined = keyed.join(found.hint("merge"), ["id_", "text_"], "left")
    out = joined.withColumn("cut_", F.when(F.col("starts").isNull(), plain).otherwise(let(F.split("text", "\n"), cut)))
    return out.select(*[F.col("cut_.text").alias("text") if c == "text" else F.col(c) for c in own], "cut_.n_lines", "cut_.n_removed")


def clean(docs: DataFrame, run: int = MIN_LINES, words: int | None = None) -> DataFrame:
    """Documents without later repeated runs. One that is left without any line, all of it being
    repeats, goes; the columns of `docs`."""
    cut = dedup_lines(carried(docs, doc_id=F.col("doc_id"), text=F.col("text")), run, words)
    return restored(cut.filter("n_removed = 0 or n_removed < n_lines"), docs, text=F.col("text"))
