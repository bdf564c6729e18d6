"""The whole run: load, clean, insert-only store, fact table, snapshot."""

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendtide.operators.clean import clean_creatives
from spendtide.operators.dedup import complete
from spendtide.session import Stages
from spendtide.sources import loads
from spendtide.sources.snapshots import commit
from spendtide.sources.tables import overwrite_weeks, rejects, with_layout


def weekly_run(
    documents: DataFrame,
    raw: str,
    signals: str,
    batch_ts: Column | None = None,
    rejected: str | None = None,
    snapshots: str | None = None,
    committed_at: datetime | None = None,
) -> dict[str, int]:
    """Store new documents in table `raw`, refresh their weeks in table `signals`.

    The table may be fed by streams too (`feeds.upsert_to_tables`), before, after and in between. Every week the
    documents mention is made anew from the partial aggregates of all loads, new rows or
    not. So a run that was cut short between its two tables is mended by running it
    again, or by the next load, and running the same documents twice changes nothing.

    A document that states no week gets the one of its start date. One without its whole key, brand or week
    is not stored: it goes to the table `rejected`, if that is named, with the reason, and is counted.
    With `snapshots` (and `committed_at`), the weeks that have new rows are also committed there as a replacement, before the
    table itself changes; a reader of that history never sees half a run. A run without new rows commits nothing.

    Returns documents read, rows stored, fact rows written and, with `rejected`, rows rejected. All are sums over
    what passes read anyway (the keys' buckets, the weeks touched, the facts by partition), of written
    tables: no table is read only to be counted, and a lost executor's work that is redone counts once.
    """
    spark, load = documents.sparkSession, loads.run_load()
    with Stages(spark) as stages:
        cleaned = stages.write(with_layout(clean_creatives(documents)), "cleaned")
        bad = rejects(cleaned.drop("yr"))
        if rejected is not None:
            bad.write.mode("append").parquet(rejected)
        storable = complete(["brand", "week_key"])
        whole = storable & complete()
        docs_read, n_good, buckets = cleaned.agg(
            F.count("*"), F.count_if(whole), F.collect_set(F.when(whole, loads.bucket_of()))
        ).first()
        good = cleaned.filter(storable).drop("yr")
        touched = loads.store(good, raw, load, sorted(buckets))
        named = ["brand", "yr", "week_key"]
        new = loads.partial_rows(spark, raw, touched).filter("kind = 0").groupBy(*named).agg(
            F.sum(F.when(F.col("feed") == load[0], F.col("ad_count"))).alias("n")
        )
        # Weeks the documents mention, and those of loads that were cut short.
        weeks = cleaned.filter(storable).select(*named, F.lit(0).cast("bigint").alias("n"), F.lit(False).alias("new"))
        weeks = weeks.unionByName(new.withColumn("new", F.lit(True))).groupBy(*named).agg(F.sum("n").alias("n"), F.max("new").alias("new"))
        weeks = stages.write(weeks, "weeks")
        added, n_new = weeks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if("new")).first()
        facts = stages.write(loads.facts_of(spark, raw, weeks, batch_ts), "facts")
        if snapshots is not None and n_new:
            commit(facts.join(weeks.filter("new").select("brand", "week_key"), ["brand", "week_key"], "left_semi"), snapshots, "replace", committed_at)
        written = overwrite_weeks(facts, signals)
        loads.finish(spark, raw, touched)
        counts = {"docs_read": docs_read, "raw_rows": added, "signal_rows": written}
        return counts if rejected is None else counts | {"rejected_rows": docs_read - n_good}
