"""Structured Streaming jobs. Each runs to the end of its input and resumes from its checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daygraph import constants as C
from daygraph.functions.columns import count_if, rows
from daygraph.operators.verify import decide, with_shares


def source(spark: SparkSession, path: str, schema, files_per_trigger: int = 64, fmt: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(path)


def run_to_table(stream: DataFrame, out: str) -> DataFrame:
    """Append a stream to a table until its input is used up, then read the table."""
    query = stream.writeStream.format("parquet").option("path", f"{out}/data").option(
        "checkpointLocation", f"{out}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{out}/data")


def run_updates(stream: DataFrame, out: str, keys: list[str], dropped: list[int] | None = None) -> DataFrame:
    """Keep the changed rows of every batch; the table is the latest row per key.

    A batch that is replayed after a failure overwrites its own folder. ``dropped`` receives the number of rows behind the watermark.
    """
    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/data/batch={number}")

    query = stream.writeStream.foreachBatch(save).option("checkpointLocation", f"{out}/checkpoint").outputMode(
        "update").trigger(availableNow=True).start()
    query.awaitTermination()
    if dropped is not None:
        dropped.append(dropped_late(query))
    return latest_rows(stream, out, keys)


def dropped_late(query) -> int:
    """Rows (after partial counts) that a finished query left out since they came behind its watermark."""
    return sum(op["numRowsDroppedByWatermark"] for progress in query.recentProgress for op in progress["stateOperators"])


def latest_rows(stream: DataFrame, out: str, keys: list[str]) -> DataFrame:
    """What ``run_updates`` has kept: the latest row per key."""
    values = [c for c in stream.columns if c not in keys]
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    written = stream.sparkSession.read.schema(schema).parquet(f"{out}/data")
    latest = written.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return latest.select(*keys, "v.*")


def ingest_score(records: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Finished records scored and gated once each; re-delivered ones are dropped inside the watermark.

    ``records`` carry the counts of a sample and ``arrived``.
    """
    once = records.withWatermark("arrived", delay).dropDuplicatesWithinWatermark(["sample_id"])
    return with_shares(once).withColumn("decision", decide())


def usage_totals(records: DataFrame) -> DataFrame:
    """Running token totals, calls, finished records and cost."""
    cost = F.sum("prompt_tokens") / 1e6 * C.PROMPT_PRICE + F.sum("completion_tokens") / 1e6 * C.COMPLETION_PRICE
    return records.groupBy(F.lit("run").alias("scope")).agg(
        F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"),
        F.sum("llm_calls").alias("llm_calls"), rows().alias("completed"), cost.alias("cost_usd"))


def latest_note(edits: DataFrame, gap: str = "1500 milliseconds", delay: str = "10 days") -> DataFrame:
    """Last edit of each burst: a burst ends after a quiet gap. ``edits``: note_id, ts, version, body."""
    burst = edits.withWatermark("ts", delay).groupBy("note_id", F.session_window("ts", gap).alias("w")).agg(
        rows().alias("edits"), F.max_by("body", F.struct("ts", "version")).alias("body"), F.max("ts").alias("last_edit"))
    return burst.select("note_id", "edits", "body", "last_edit")


def decision_rates(records: DataFrame, size: str, slide: str | None = None, delay: str = "3 days") -> DataFrame:
    """Finished records and decisions per language in tumbling or sliding windows."""
    w = F.window("finished", size, slide) if slide else F.window("finished", size)
    return records.withWatermark("finished", delay).groupBy(w.alias("w"), "language").agg(
        rows().alias("n"), *[count_if(F.col("decision") == d).alias(f"n_{d}") for d in C.DECISIONS]).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), "language", "n", *[f"n_{d}" for d in C.DECISIONS])


def run_day_diff(entries: DataFrame, out: str, keep: str = "INTERVAL 31 DAYS") -> DataFrame:
    """Added, recurring and removed concepts against the participant's entry before, for entries in any order of arrival.

    ``entries``: participant_id, sample_id, entry_no, entry_date, concepts (a set bounded by the vocabulary; null is empty).
    Every batch joins its entries with the open ones of the batches before: those that still lack the entry before or the
    one after, and are at most ``keep`` older than the newest entry date. An entry that comes late changes the row of its
    successor, if that is still open. State is a table per batch; a replayed batch reads the state of the batch before it
    and overwrites its own, so results are the same. The result is the latest row per sample; a row that
    knows the entry before goes first, so one delivered again does not lose it. Entries without a participant or number have no neighbours.
    """
    flags = [T.StructField(c, T.BooleanType()) for c in ("met_before", "met_after")]
    schema = T.StructType([*(entries.schema[c] for c in DIFF_COLUMNS), *flags, T.StructField("newest", T.DateType())])
    spark = entries.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        identity = ["participant_id", "entry_no", "sample_id"]
        fresh = batch.select(*DIFF_COLUMNS, F.lit(False).alias("met_before"), F.lit(False).alias("met_after"), F.lit(None).cast("date").alias("newest"),
                             F.lit(True).alias("fresh")).dropDuplicates(identity)
        if number:
            state = batch.sparkSession.read.schema(schema).parquet(f"{out}/state/batch={number - 1}")
            fresh = fresh.unionByName(state.join(fresh.select(*identity), identity, "left_anti").withColumn("fresh", F.lit(False)))
        place = f"{out}/known/batch={number}"
        fresh.write.mode("overwrite").parquet(place)
        known = batch.sparkSession.read.schema(fresh.schema).parquet(place)
        before = known.select("participant_id", (F.col("entry_no") + 1).alias("entry_no"), F.col("concepts").alias("earlier"), F.col("fresh").alias("fresh_before"), F.lit(True).alias("has_before"))
        after = known.select("participant_id", (F.col("entry_no") - 1).alias("entry_no"), F.lit(True).alias("has_after")).distinct()
        met = known.join(before, ["participant_id", "entry_no"], "left").join(after, ["participant_id", "entry_no"], "left")
        none = F.array().cast("array<string>")
        now, earlier = F.coalesce("concepts", none), F.coalesce("earlier", none)
        count = lambda found: F.when(F.col("has_before"), F.size(found)).otherwise(0).cast("long")
        met.where("fresh OR fresh_before").select(
            "participant_id", "sample_id", "entry_no", F.col("has_before").isNull().alias("first_day"), count(F.array_except(now, earlier)).alias("added"),
            count(F.array_intersect(now, earlier)).alias("recurring"), count(F.array_except(earlier, now)).alias("removed"),
        ).write.mode("overwrite").parquet(f"{out}/data/batch={number}")
        newest = known.agg(F.greatest(F.max("entry_date"), F.max("newest")).alias("newest"))
        met = met.withColumns({f"met_{side}": F.col(f"met_{side}") | F.col(f"has_{side}").isNotNull() for side in ("before", "after")}).drop("newest")
        open_ = met.where("NOT (met_before AND met_after)").crossJoin(F.broadcast(newest))  # one row
        open_.where(F.expr(f"entry_date >= newest - {keep}")).select(*schema.names).write.mode("overwrite").parquet(f"{out}/state/batch={number}")

    query = entries.writeStream.foreachBatch(step).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    rows_ = spark.read.schema(f"{DIFF_SCHEMA}, batch long").parquet(f"{out}/data")
    values = ["entry_no", "first_day", "added", "recurring", "removed"]
    best = F.max_by(F.struct(*values), F.struct(~F.col("first_day"), F.col("batch")))
    return rows_.groupBy("participant_id", "sample_id").agg(best.alias("v")).select("participant_id", "sample_id", "v.*")


DIFF_COLUMNS = ["participant_id", "sample_id", "entry_no", "entry_date", "concepts"]
DIFF_SCHEMA = "participant_id string, sample_id string, entry_no long, first_day boolean, added long, recurring long, removed long"
