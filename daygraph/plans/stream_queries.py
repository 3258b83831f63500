"""Registered streaming queries. Inputs are written from the tables, the stream runs to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from daygraph.functions.columns import r6
from daygraph.operators.prepare import sample_labels
from daygraph.plans import verify_queries as VQ
from daygraph.plans.journal_queries import journal
from daygraph.session import fresh_path
from daygraph.sources.day_graphs import DayGraphs
from daygraph.streaming import streams as ST


def feed(df, name, parts, by=None):
    """Write the input in the given order of parts, as a producer would."""
    path = fresh_path(df.sparkSession, name)
    for part in parts:
        chunk = df.where(part)
        (chunk.repartition(by) if by else chunk).write.mode("append").parquet(path)
    return path


COUNTS = ["sample_id", "language", "scenario", "parsed", "nodes_total", "nodes_mentioned", "nodes_timed", "edges_total", "edges_expressed",
          "hallucination_count", "bad_nodes", "bad_edges"]


def stream_ingest_score(spark, sf_dir):
    """Every tenth record is delivered twice."""
    t = DayGraphs(spark, sf_dir)
    counted = VQ.stored_decisions(t).select(*COUNTS)
    again = t.samples().where("(user_id + day_index) % 10 = 0").select("sample_id")
    twice = counted.withColumn("delivery", F.lit(1)).unionByName(counted.join(again, "sample_id", "left_semi").withColumn("delivery", F.lit(2)))
    path = feed(twice, "records", ["delivery = 1", "delivery = 2"])
    stream = ST.source(spark, path, twice.schema, 4).withColumn("arrived", F.col("_metadata.file_modification_time"))
    scored = ST.ingest_score(stream).select("sample_id", "overall_confidence", "decision")
    return ST.run_to_table(scored, fresh_path(spark, "scored")).withColumn("overall_confidence", r6(F.col("overall_confidence")))


def stream_usage_totals(spark, sf_dir):
    s = DayGraphs(spark, sf_dir).samples().select("sample_id", "day_index", "prompt_tokens", "completion_tokens", "llm_calls")
    path = feed(s, "usage", ["day_index <= 5", "day_index BETWEEN 6 AND 10", "day_index > 10"])
    out = ST.run_updates(ST.usage_totals(ST.source(spark, path, s.schema, 4)), fresh_path(spark, "totals"), ["scope"])
    return out.drop("scope").withColumn("cost_usd", r6(F.col("cost_usd")))


WEEKS = ["ts < '2024-01-09'", "ts >= '2024-01-09' AND ts < '2024-01-17'", "ts >= '2024-01-17' AND ts < '2024-01-25'", "ts >= '2024-01-25'"]


def stream_latest_note(spark, sf_dir):
    """Events as edits with a quiet gap of six hours; an end mark far ahead closes the last bursts."""
    ev = DayGraphs(spark, sf_dir).table("events").select(
        F.col("user_id").alias("note_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("version"), F.col("props").alias("body"))
    end = spark.sql("SELECT -1L AS note_id, TIMESTAMP '2099-01-01 00:00:00' AS ts, -1L AS version, '' AS body")
    path = feed(ev.unionByName(end), "edits", WEEKS)
    notes = ST.run_to_table(ST.latest_note(ST.source(spark, path, ev.schema, 64), "6 hours"), fresh_path(spark, "notes"))
    return notes.where("note_id >= 0").withColumn("last_edit", F.date_format("last_edit", "yyyy-MM-dd HH:mm:ss"))


def finished_records(t):
    last = t.table("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    done = t.nodes().select("sample_id", "event_id").join(last, "event_id").groupBy("sample_id").agg(F.max("ts").alias("finished"))
    return VQ.stored_decisions(t).select("sample_id", "language", "decision").join(done, "sample_id")


def stream_decision_rates(spark, sf_dir):
    """Tumbling days and sliding two-day windows, stopped and resumed. Before the second run records come that are far
    behind the watermark: the stream leaves them out, and its progress counts them (``late_dropped``)."""
    records = finished_records(DayGraphs(spark, sf_dir))
    newest = F.to_date(F.lit(records.agg(F.max("finished")).scalar()))
    late = records.where(F.col("sample_id").like("%0\\_d%") & (F.to_date("finished") < F.date_sub(newest, 13)))
    out = None
    for kind, size, slide in (("tumbling", "1 day", None), ("sliding", "2 days", "1 day")):
        path = feed(records, "finished", [w.replace("ts", "finished") for w in WEEKS])
        rates = ST.decision_rates(ST.source(spark, path, records.schema, 64), size, slide, "10 days")
        place, dropped, keys = fresh_path(spark, "rates"), [], ["start", "end", "language"]
        ST.run_updates(rates, place, keys)
        late.write.mode("append").parquet(path)
        table = ST.run_updates(rates, place, keys, dropped).withColumns({"kind": F.lit(kind), "late_dropped": F.lit(dropped[0] > 0)})
        out = table if out is None else out.unionByName(table)
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return out.withColumns({"start": day("start"), "end": day("end")}).withColumnsRenamed({"start": "window_start", "end": "window_end"})


def stream_day_diff(spark, sf_dir):
    """Entries come out of order: the second week before the first."""
    t = DayGraphs(spark, sf_dir)
    place = journal(spark, sf_dir).numbered.where("eligible").select("sample_id", "participant_id", "entry_no", "entry_date")
    sets = sample_labels(t.nodes()).groupBy("sample_id").agg(F.array_sort(F.collect_set("concept_id")).alias("concepts"))
    entries = place.join(sets, "sample_id")
    path = feed(entries, "entries", ["entry_no BETWEEN 6 AND 10", "entry_no <= 5", "entry_no > 10"], "participant_id")
    return ST.run_day_diff(ST.source(spark, path, entries.schema, 4), fresh_path(spark, "diffs"))


QUERIES = {f.__name__: f for f in [stream_ingest_score, stream_usage_totals, stream_latest_note, stream_decision_rates, stream_day_diff]}
