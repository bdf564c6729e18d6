"""Briefs kept per snapshot: a brand is written about once, unless asked again."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendtide.operators.brief import answered_briefs, brief_context, brief_response
from spendtide.session import remove, staged
from spendtide.sources.tables import exists


def saved_briefs(
    summary: DataFrame,
    path: str,
    snapshot_id: int,
    writer: Callable[[str, str], str],
    refresh: bool = False,
    task: str = "%s",
    requirements: str = "",
    role: str = "",
    attempts: int = 3,
    parallel: int = 4,
    pause: float = 1.0,
) -> DataFrame:
    """Response rows of every brand of `summary`, from the saved table where it has them.

    Only brands without a row for this snapshot reach the writer; `refresh` writes all
    again. Each call's rows go to a run folder of their own, and the newest run counts. Answers are kept one by one as they
    come (`brief.answered_briefs`); a call that crashed is taken up by the next, which asks only for what is missing.
    """
    spark = summary.sparkSession
    home = f"{path}/snapshot_id={int(snapshot_id)}"
    summary = staged(summary, "summary")
    run, todo = 0, summary
    if exists(spark, home):
        kept = spark.read.parquet(home)
        run = kept.agg(F.max("run")).first()[0] + 1
        if not refresh:
            todo = summary.join(kept.select("brand").distinct(), "brand", "left_anti")
    answers = f"{path}_answers/snapshot_id={int(snapshot_id)}/run={run}"
    texts = answered_briefs(brief_context(todo, task, requirements), answers, writer, role, attempts, parallel, pause)
    brief_response(todo, texts).write.mode("overwrite").parquet(f"{home}/run={run}")
    remove(spark, answers)
    rows = spark.read.parquet(home)
    answer = [c for c in rows.columns if c not in ("brand", "run")]
    newest = rows.groupBy("brand").agg(F.max(F.struct("run", *answer)).alias("row"))
    return newest.join(summary.select("brand"), "brand", "left_semi").select("brand", *[f"row.{c}" for c in answer])
