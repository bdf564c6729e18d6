"""Order landed archive pages by their `next` cursors.

A page is landed under the cursor that it was asked for by (none for a walk's first) and names the
cursor of the page after it. Files say nothing of the order, so it is found by doubling: with a table of where
2^k steps lead from every page, the first 2^k pages of all walks become the first 2^(k+1) in one join. A walk of a
million pages takes 20 rounds; joins are on pages, so one walk may hold any share of them.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendtide.session import Stages, staged

#: States of a landed page, and how a walk ends.
WALKED, UNREACHED, COPY = "walked", "unreached", "copy"
END, GAP, CYCLE, NO_START = "end", "gap", "cycle", "no start"


def _none_if_empty(c: Column) -> Column:
    return F.when(c != "", c)


def _numbered(pages: DataFrame, walk: str, cursor: str, next_cursor: Column) -> DataFrame:
    """Pages with a number each, and which of those with one cursor counts: equal ones are told apart by number only."""
    cols = {"cursor_": F.coalesce(F.col(cursor), F.lit("")), "next_": _none_if_empty(next_cursor), "walk_": F.col(walk)}
    own = F.struct(*[F.col(c) for c in pages.columns])
    # Files of one cursor that differ: the first by content stands, whatever the order that they are read in.
    content = F.xxhash64(F.to_json(own))
    return pages.select(own.alias("page_"), *[v.alias(k) for k, v in cols.items()], content.alias("content_"), F.monotonically_increasing_id().alias("id_"))


def ordered_pages(pages: DataFrame, next_cursor: Column, walk: str = "brand", cursor: str = "cursor") -> tuple[DataFrame, DataFrame]:
    """(`pages` with page_index and state, one row per walk).

    page_index counts from 0 along the walk and is null off it. A page is `walked`; `unreached` where no chain from
    the walk's first page leads to it; or a `copy`: another page of its cursor stands for it (the one with the
    least hash of its content, so always the same). Page numbers landed with the pages play no part.

    The second frame: walk, n_pages, n_walked, ended, missing. A walk ends at a page without `next` ('end'), at one whose
    next page has not landed ('gap', its cursor is `missing`), or at one that leads back ('cycle'); without a first page
    it has 'no start'. Where pages of several chains lead to one page, it is walked once.

    A null walk is a walk like others. A page without cursor, or with an empty one, is a first page. Pages that were landed
    twice are copies, however many. No pages, no rows. Both frames read a written table.
    """
    with Stages(pages.sparkSession) as stages:
        nodes, first, names, reached = _reached(pages, next_cursor, walk, cursor, stages)
        out = staged(_placed(pages, nodes, first, reached), "ordered")
        return out, staged(_ends(nodes, first.join(reached, "id_", "left"), names), "walks")


def _reached(
    pages: DataFrame, next_cursor: Column, walk: str, cursor: str, stages: Stages, most: int | None = None
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Numbered pages, the one that counts per cursor, the names of those, and the places of all pages that are reached, or of the `most` first.

    After k rounds the pages of the first 2^k places are found, each with its least place; so rounds end with `most`.
    """
    nodes = stages.write(_numbered(pages, walk, cursor, next_cursor), "nodes")
    first = nodes.groupBy("walk_", "cursor_").agg(F.min(F.struct("content_", "id_", "next_")).alias("m"))
    first = stages.write(first.select("walk_", "cursor_", F.col("m.id_").alias("id_"), F.col("m.next_").alias("next_")), "first")
    names = first.select(F.col("walk_").alias("w"), F.col("cursor_").alias("next_"), F.col("id_").alias("to_"))
    jump = first.join(names, F.col("walk_").eqNullSafe(F.col("w")) & (first["next_"] == names["next_"])).select("id_", "to_")
    jump = stages.write(jump, "jump")
    reached = stages.write(first.filter("cursor_ = ''").select("id_", F.lit(0).cast("bigint").alias("at_")), "reached")
    total, size = reached.count(), 1
    while total and (most is None or size < most):
        hop = jump.select("id_", "to_")
        ahead = reached.join(hop, "id_").select(F.col("to_").alias("id_"), (F.col("at_") + size).alias("at_"))
        # A page met again is met by a cycle: its first place counts.
        reached = stages.write(reached.unionByName(ahead).groupBy("id_").agg(F.min("at_").alias("at_")), "reached")
        now = reached.count()
        if now == total:
            break
        further = jump.select(F.col("id_").alias("to_"), F.col("to_").alias("beyond_"))
        jump = stages.write(hop.join(further, "to_").select("id_", F.col("beyond_").alias("to_")), "jump")
        total, size = now, 2 * size
    return nodes, first, names, reached


def _placed(pages: DataFrame, nodes: DataFrame, first: DataFrame, reached: DataFrame) -> DataFrame:
    places = first.select("id_").join(reached, "id_", "left").withColumn("first_", F.lit(True))
    state = F.when(F.col("first_").isNull(), COPY).when(F.col("at_").isNull(), UNREACHED).otherwise(WALKED)
    return nodes.join(places, "id_", "left").select(
        *_own(pages), F.col("at_").alias("page_index"), state.alias("state"),
    )


def _own(pages: DataFrame) -> list[Column]:
    return [F.col(f"page_.`{c}`").alias(c) for c in pages.columns if c not in ("page_index", "state")]


def _ends(nodes: DataFrame, first: DataFrame, names: DataFrame) -> DataFrame:
    walks = nodes.groupBy("walk_").agg(F.count("*").alias("n_pages"))
    last = first.groupBy("walk_").agg(F.count("at_").alias("n_walked"), F.max_by("next_", "at_").alias("next_"))
    ended = walks.alias("a").join(last.alias("b"), F.col("a.walk_").eqNullSafe(F.col("b.walk_"))).select("a.walk_", "n_pages", "n_walked", "next_")
    found = ended.alias("e").join(
        names.alias("n"), F.col("e.walk_").eqNullSafe(F.col("n.w")) & (F.col("e.next_") == F.col("n.next_")), "left"
    )
    how = (
        F.when(F.col("n_walked") == 0, NO_START).when(F.col("e.next_").isNull(), END)
        .when(F.col("to_").isNull(), GAP).otherwise(CYCLE)
    )
    return found.select(
        F.col("e.walk_").alias("walk"), "n_pages", "n_walked", how.alias("ended"), F.when(how == GAP, F.col("e.next_")).alias("missing")
    )


def walked_pages(pages: DataFrame, max_pages: int | None = None, walk: str = "brand", cursor: str = "cursor") -> DataFrame:
    """The pages of every walk with their page_index, or the first `max_pages` of each; what is off the walks is left out."""
    if max_pages is None:
        ordered, _ = ordered_pages(pages, F.col("paging")["next"], walk, cursor)
        return ordered.filter(F.col("state") == WALKED).drop("state")
    with Stages(pages.sparkSession) as stages:
        nodes, _, _, reached = _reached(pages, F.col("paging")["next"], walk, cursor, stages, max_pages)
        some = nodes.join(reached.filter(F.col("at_") < max_pages), "id_")
        return staged(some.select(*_own(pages), F.col("at_").alias("page_index")), "walked")
