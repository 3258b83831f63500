"""Registered queries on verification, the gate and run bookkeeping."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from daygraph import constants as C
from daygraph.functions import text as X
from daygraph.functions.columns import count_if, r6, rows
from daygraph.functions.ranking import nearest_rank
from daygraph.operators import graph as G
from daygraph.operators import verify as V
from daygraph.sources.day_graphs import DayGraphs


def judged(t: DayGraphs):
    return V.judged_nodes(t.nodes(), t.node_verdicts()), V.judged_edges(t.edges(), t.edge_verdicts())


def stored_decisions(t: DayGraphs):
    """The decision kept on each record, from the verifier's items and the time references of its text."""
    return t.stored("decided", lambda: V.decisions(full_scores(t)))


def records(t: DayGraphs):
    """Sample columns with the stored decision."""
    return t.samples().join(stored_decisions(t).select("sample_id", "decision"), "sample_id")


def rounded(df, *cols):
    return df.withColumns({c: r6(F.col(c)) for c in cols})


SHARES = ["node_coverage", "edge_coverage", "temporal_consistency", "hallucination_score", "overall_confidence"]


def merged_extras(t):
    timed = V.time_extras(t.texts(), t.nodes()).select("sample_id", "time_extras")
    return t.extras().join(timed, "sample_id").select(
        "sample_id", V.merge_extras(F.col("extra_content"), F.col("time_extras")).alias("merged"))


def full_scores(t):
    nodes, edges = judged(t)
    return V.scores(t.samples(), nodes, edges, merged_extras(t).select("sample_id", F.size("merged").cast("long").alias("n")))


def verification_join(spark, sf_dir):
    return judged(DayGraphs(spark, sf_dir))[0].select("sample_id", "node_id", "mentioned", "temporal_correct")


def verifier_completeness(spark, sf_dir):
    return V.completeness(*judged(DayGraphs(spark, sf_dir)))


def extra_time_references(spark, sf_dir):
    t = DayGraphs(spark, sf_dir)
    found = V.time_extras(t.texts(), t.nodes()).select("sample_id", F.explode("time_extras").alias("x"))
    return found.select("sample_id", "x.content", "x.evidence")


def merge_extra_content(spark, sf_dir):
    found = merged_extras(DayGraphs(spark, sf_dir)).select("sample_id", F.explode("merged").alias("x"))
    return found.select("sample_id", "x.content", "x.evidence")


def verification_scores(spark, sf_dir):
    return rounded(full_scores(DayGraphs(spark, sf_dir)), *SHARES)


def decide_gate(spark, sf_dir):
    return V.decisions(full_scores(DayGraphs(spark, sf_dir))).select("sample_id", "decision")


def decision_reason(spark, sf_dir):
    t = DayGraphs(spark, sf_dir)
    nodes, edges = judged(t)
    extras = merged_extras(t).select("sample_id", F.transform("merged", lambda x: x["content"]).alias("contents"))
    return V.reasons(stored_decisions(t), nodes, edges, extras)


def forced_reject(spark, sf_dir):
    d = stored_decisions(DayGraphs(spark, sf_dir)).where("NOT parsed OR bad_nodes + bad_edges > 0")
    return rounded(d.select(
        "sample_id", F.when(F.col("parsed"), "incomplete").otherwise("unparsed").alias("verifier"), "bad_nodes", "bad_edges",
        "nodes_mentioned", *SHARES, "decision"), *SHARES)


def decision_breakdown(spark, sf_dir):
    out = V.decision_breakdown(stored_decisions(DayGraphs(spark, sf_dir)))
    return rounded(out, *[f"{d}_rate" for d in C.DECISIONS])


def mean_scores(spark, sf_dir):
    t = DayGraphs(spark, sf_dir)
    return rounded(V.mean_scores(stored_decisions(t), t.samples()), *SHARES)


def usage_ledger(spark, sf_dir):
    return rounded(V.usage_ledger(DayGraphs(spark, sf_dir).samples(), 47_714), "cost_usd", "cost_per_sample", "extrapolated_usd")


def expectation_checks(spark, sf_dir):
    t = DayGraphs(spark, sf_dir)
    totals = records(t).agg(
        rows().alias("total"), *[count_if(F.col("decision") == d).alias(f"decisions.{d}") for d in C.DECISIONS],
        *[count_if((F.col("decision") == "accept") & (F.col("language") == g)).alias(f"accepted.{g}") for g in ("en", "de")],
        F.countDistinct("participant_id").alias("participants"))
    measured = totals.unpivot([], [f"`{c}`" for c in totals.columns], "field", "measured")
    # The published corpus counts.
    return V.expectation_checks(measured, {
        "total": 47714, "decisions.accept": 41315, "decisions.review": 4950, "decisions.reject": 1449,
        "accepted.en": 20982, "accepted.de": 20333, "participants": 3410})


def graph_hash(spark, sf_dir):
    t = DayGraphs(spark, sf_dir)
    return V.graph_hash(t.nodes(), t.edges())


def pending_samples(spark, sf_dir):
    """Samples with no finished record; every sixth record is left out as unfinished."""
    t = DayGraphs(spark, sf_dir)
    finished = stored_decisions(t).join(t.samples().where("(user_id + day_index) % 6 <> 0").select("sample_id"), "sample_id", "left_semi")
    return t.samples().join(finished, "sample_id", "left_anti").select("sample_id", "participant_id")


def drift_input(t):
    hashes = V.graph_hash(t.nodes(), t.edges()).join(t.samples().select("sample_id", "user_id", "day_index"), "sample_id")
    old = hashes.where("(user_id + day_index) % 20 <> 0").select(
        "sample_id", F.when(F.col("user_id") % 19 == 0, 1).otherwise(2).alias("version"), "graph_hash")
    changed = F.when(F.col("day_index") % 11 == 0, F.sha1("graph_hash")).otherwise(F.col("graph_hash"))
    new = hashes.where("(user_id + day_index) % 20 <> 1").select("sample_id", F.lit(2).alias("version"), changed.alias("graph_hash"))
    return old, new


def graph_drift(spark, sf_dir):
    """States with counts and the verdict of the whole run (resume only if nothing drifted)."""
    states = V.graph_drift(*drift_input(DayGraphs(spark, sf_dir)))
    counts = states.groupBy("state").agg(rows().alias("n"), F.min("sample_id").alias("first_sample"))
    # A row per state, five at most.
    return counts.withColumn("resumable", F.min(F.col("state") == "same").over(Window.partitionBy()))


def pick_examples(spark, sf_dir):
    return V.pick_examples(records(DayGraphs(spark, sf_dir)))


def filter_decision(spark, sf_dir):
    return records(DayGraphs(spark, sf_dir)).where(F.col("decision").isin("accept", "review")).select("sample_id", "decision")


def language_fallback(spark, sf_dir):
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    return DayGraphs(spark, sf_dir).samples().select(
        "sample_id", F.coalesce(blank("record_language"), blank("participant_language"), F.lit("en")).alias("language"))


def filter_language(spark, sf_dir):
    return DayGraphs(spark, sf_dir).samples().where(F.col("language").isin("de")).select("sample_id", "language")


def typepair_connectivity_accepted(spark, sf_dir):
    t = DayGraphs(spark, sf_dir)
    keep = stored_decisions(t).where("decision = 'accept'").select("sample_id")
    stats = G.typepair_connectivity(t.nodes().join(keep, "sample_id", "left_semi"), t.edges().join(keep, "sample_id", "left_semi"))
    common = stats.where(F.col("cooccur") >= C.BAND_MIN_COUNT)
    return rounded(G.band_flag(common, C.BAND_MIN_COUNT, strict=False), "p")


def corpus_stats(spark, sf_dir):
    r = records(DayGraphs(spark, sf_dir))
    return r.agg(
        rows().alias("samples"), F.countDistinct("participant_id").alias("participants"),
        *[count_if(F.col("decision") == d).alias(d) for d in C.DECISIONS],
        *[count_if(F.col("language") == g).alias(f"{g}_all") for g in ("en", "de")],
        *[count_if((F.col("language") == g) & (F.col("decision") == "accept")).alias(f"{g}_accepted") for g in ("en", "de")],
        F.min("age").cast("long").alias("age_min"), F.max("age").cast("long").alias("age_max"), r6(F.avg("age")).alias("age_mean"),
        F.countDistinct("scenario").alias("scenarios"))


def frequency_tables(spark, sf_dir):
    t = DayGraphs(spark, sf_dir)
    facets = t.samples().select(F.explode(F.create_map(F.lit("style"), "writing_style", F.lit("scenario"), "scenario")).alias("facet", "value"))
    pool = t.concepts().select(F.explode(F.create_map(F.lit("concept_type"), "type", F.lit("polarity"), "polarity")).alias("facet", "value"))
    counts = facets.unionByName(pool).groupBy("facet", "value").agg(rows().alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("n"), "value")).cast("long"))


def nearest_rank_percentiles(spark, sf_dir):
    t = DayGraphs(spark, sf_dir)
    words = t.texts().select("sample_id", F.lit("words").alias("measure"), X.word_count(F.col("text")).alias("v"))
    nodes = t.samples().select("sample_id", F.lit("nodes").alias("measure"), F.col("n_nodes").alias("v"))
    edges = t.samples().select("sample_id").join(t.edges().groupBy("sample_id").agg(rows().alias("v")), "sample_id", "left").select(
        "sample_id", F.lit("edges").alias("measure"), F.coalesce("v", F.lit(0)).cast("long").alias("v"))
    shares = {"min": 0.0, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "max": 1.0}
    return nearest_rank(words.unionByName(nodes).unionByName(edges), ["measure"], "v", shares)


QUERIES = {f.__name__: f for f in [
    verification_join, verifier_completeness, extra_time_references, merge_extra_content, verification_scores, decide_gate,
    decision_reason, forced_reject, decision_breakdown, mean_scores, usage_ledger, expectation_checks, graph_hash,
    pending_samples, graph_drift, pick_examples, filter_decision, language_fallback, filter_language,
    typepair_connectivity_accepted, corpus_stats, frequency_tables, nearest_rank_percentiles,
]}
