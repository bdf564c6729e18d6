"""Quality rules: word and symbol counts, repeated words, and lines frequent across documents."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendtide.llm.common import SPACES, carried, has_word, let, lower_ascii, restored, scratch, staged, words

# Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: A line is boilerplate of its host if more distinct documents hold it than both of these.
MIN_DOCS = 20
MAX_SHARE_PERCENT = 10
#: Where the caller asks for it, this share suffices for a line with so many characters: long lines do not recur by chance.
LONG_SHARE_PERCENT = 1
LONG_LINE_CHARS = 40
#: A document of which fewer characters than this remain without such lines is depleted.
MIN_KEPT_PERCENT = 30


def word_chars(c: Column) -> Column:
    return F.length(F.translate(c, SPACES, ""))


def lines_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), has_word)


def normal_line(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case, digits run together as 0."""
    return F.regexp_replace(lower_ascii(F.btrim(line, F.lit(SPACES))), "[0-9]+", "0")


def line_hash(line: Column) -> Column:
    return F.xxhash64(normal_line(line))


def n_repeat_words(w: Column) -> Column:
    """Words inside three-word windows that the list holds twice or more.

    Windows are hashed and sorted with their places, so equal ones meet; each place that has an
    equal neighbour covers three words, less what the next such place covers.
    """
    def repeated(s: Column) -> Column:
        same = lambda j, k: F.coalesce(F.get(s, j)["h"] == F.get(s, k)["h"], F.lit(False))
        hits = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: same(j, j - 1) | same(j, j + 1))
        return F.sort_array(F.transform(hits, lambda j: F.get(s, j)["p"]))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    triples = F.transform(
        F.sequence(F.lit(0), F.size(w) - 3),
        lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("p")),
    )
    return F.when(F.size(w) < 4, 0).otherwise(let(F.sort_array(triples), lambda s: let(repeated(s), covered)))


@scratch
def frequent_lines(docs: DataFrame, host: str = "source", long_lines: bool = False) -> DataFrame:
    """One row per host that has boilerplate: host_, frequent (hashes of lines).

    Distinct documents of a host are its distinct texts, so exact copies count once. A line of a
    frequent list is in over a tenth of its host's documents: a list has at most ten times as many entries
    as the host's documents have lines on average. With `long_lines`, a hundredth is enough for a line of
    LONG_LINE_CHARS characters (normalised, without white space), and a list may be ten times as long.

    Pairs of document and line are made distinct first, so counting starts from pre-aggregated rows and
    a line that very many documents share reaches its reducer as one count per task.
    """
    def line(c: Column) -> Column:
        if not long_lines:
            return F.struct(line_hash(c).alias("line_"), F.lit(False).alias("long_"))
        return let(normal_line(c), lambda x: F.struct(F.xxhash64(x).alias("line_"), (word_chars(x) >= LONG_LINE_CHARS).alias("long_")))

    keyed = docs.select(
        F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host_"),
        F.xxhash64("text").alias("doc_"), F.xxhash64(F.lit(1), "text").alias("doc2_"),
        F.array_distinct(F.transform(lines_of(F.col("text")), line)).alias("lines_"),
    )
    pairs = keyed.select("host_", "doc_", "doc2_", F.explode_outer("lines_").alias("l_"))
    pairs = pairs.select("host_", "doc_", "doc2_", "l_.line_", *["l_.long_"] * long_lines).distinct()
    # A document without lines still counts for its host, as one line that is null.
    found = staged(pairs, "lines")
    hosts = found.select("host_", "doc_", "doc2_").distinct().groupBy("host_").agg(F.count("*").alias("docs_"))
    by = ["host_", "line_", *["long_"] * long_lines]
    counts = found.filter("line_ is not null").groupBy(*by).agg(F.count("*").alias("n_")).filter(F.col("n_") > MIN_DOCS)
    percent = F.when(F.col("long_"), LONG_SHARE_PERCENT).otherwise(MAX_SHARE_PERCENT) if long_lines else F.lit(MAX_SHARE_PERCENT)
    over = staged(counts, "counts").join(hosts, "host_").filter(F.col("n_") * 100 > F.col("docs_") * percent)
    return staged(over.groupBy("host_").agg(F.collect_set("line_").alias("frequent")), "frequent", keep=True)


def judge(docs: DataFrame, host: str = "source", with_text: bool = False, long_lines: bool = False) -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_frequent_lines,
    base_failed, depleted, kept; with `with_text` also clean_text.

    The base rules fail a document of fewer than 50 words, or over half of whose words stand in
    repeated three-word windows. The method: lines that are frequent among the host's documents are
    removed, and a document that keeps under 30 % of its characters is depleted. `kept` is neither.
    clean_text is the text without frequent lines, unchanged if it has none. With `long_lines`, a long
    line is frequent in a hundredth of the host's documents already.

    A null text has no words: it fails. A null host counts as an empty one. Every row is judged for
    itself, so repeated rows and null ids stay as they are. Columns of `docs` that have one of the
    new names are replaced. An empty table gives no rows.
    """
    lists = frequent_lines(docs, host, long_lines)
    none = F.array().cast("array<bigint>")
    joined = docs.withColumn("host_", F.coalesce(F.col(host).cast("string"), F.lit(""))).join(lists, "host_", "left")
    text = F.coalesce(F.col("text"), F.lit(""))
    bad = F.coalesce("frequent", none)

    def of_lines(ls: Column) -> Column:
        removed = F.filter(ls, lambda line: F.array_contains(bad, line_hash(line)))
        removed = F.when(F.size(bad) == 0, F.array().cast("array<string>")).otherwise(removed)
        total = lambda a: F.aggregate(a, F.lit(0), lambda n, line: n + word_chars(line))
        return let(removed, lambda r: F.struct(
            (F.size(ls) - F.size(F.array_distinct(ls))).cast("bigint").alias("n_dup_lines"),
            F.size(r).cast("bigint").alias("n_frequent_lines"), total(r).cast("bigint").alias("removed_chars"),
        ))

    of_words = let(words(F.col("text")), lambda w: F.struct(
        F.size(w).cast("bigint").alias("n_words"), n_repeat_words(w).cast("bigint").alias("n_repeat_words")
    ))
    new = {
        "n_words": F.col("words_.n_words"),
        "word_chars": word_chars(text).cast("bigint"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint"),
        "n_dup_lines": F.col("lines_.n_dup_lines"),
        "n_repeat_words": F.col("words_.n_repeat_words"),
        "n_frequent_lines": F.col("lines_.n_frequent_lines"),
        "removed_chars": F.col("lines_.removed_chars"),
    }
    if with_text:
        new["clean_text"] = F.when(F.col("lines_.n_frequent_lines") == 0, F.col("text")).otherwise(F.array_join(
            F.filter(F.split("text", "\n"), lambda line: ~(has_word(line) & F.array_contains(bad, line_hash(line)))), "\n"
        ))
    own = [c for c in docs.columns if c not in new and c not in ("base_failed", "depleted", "kept")]
    out = joined.withColumns({"words_": of_words, "lines_": let(lines_of(F.col("text")), of_lines)})
    out = out.select(*[F.col(c) for c in own], *[v.alias(k) for k, v in new.items()])
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    depleted = (F.col("word_chars") - F.col("removed_chars")) * 100 < F.col("word_chars") * MIN_KEPT_PERCENT
    return out.select(
        "*", failed.alias("base_failed"), depleted.alias("depleted"), (~failed & ~depleted).alias("kept")
    ).drop("removed_chars")


def clean(docs: DataFrame, host: str = "source", long_lines: bool = False) -> DataFrame:
    """The documents that are kept, without their hosts' frequent lines; the columns of `docs`."""
    judged = judge(carried(docs, text=F.col("text"), host=F.col(host)), "host", with_text=True, long_lines=long_lines)
    return restored(judged.filter("kept"), docs, text=F.col("clean_text"))
