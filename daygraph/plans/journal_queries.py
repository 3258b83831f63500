"""Registered queries on journals."""

from __future__ import annotations

from pyspark.sql import functions as F

from daygraph import constants as C
from daygraph.functions import text as X
from daygraph.functions.columns import r6
from daygraph.operators import journal as J
from daygraph.sources.day_graphs import DayGraphs


def entries(t: DayGraphs):
    """Entries with mood and whether their text, without markup, is long enough."""
    def build():
        enough = t.texts().select("sample_id", (F.length(X.clean_markdown(F.col("text"))) >= C.MIN_TEXT_LENGTH).alias("eligible"))
        return t.samples().select("sample_id", "participant_id", "entry_date", "mood_score").join(enough, "sample_id")
    return t.stored("entries", build)


def journal(spark, sf_dir) -> J.Journal:
    t = DayGraphs(spark, sf_dir)
    return J.Journal(entries(t), t.nodes(), t.edges())


def shown(df, *floats):
    """Dates as text and floats at six decimals."""
    dates = {f.name: F.date_format(f.name, "yyyy-MM-dd") for f in df.schema if f.dataType.typeName() == "date"}
    return df.withColumns({**dates, **{c: r6(F.col(c)) for c in floats}})


def classify_problem_coping(spark, sf_dir):
    return journal(spark, sf_dir).first_seen_meta.select("participant_id", "concept_id", J.is_problem().alias("problem"), J.is_coping().alias("coping"))


def first_seen_meta(spark, sf_dir):
    return journal(spark, sf_dir).first_seen_meta


def concept_days(spark, sf_dir):
    return shown(journal(spark, sf_dir).concept_days)


def mood_per_date(spark, sf_dir):
    return shown(journal(spark, sf_dir).moods, "mood")


def mood_series(spark, sf_dir):
    return shown(journal(spark, sf_dir).numbered.select("participant_id", "entry_no", "entry_date", "mood_score"), "mood_score")


def mood_overview(spark, sf_dir):
    return shown(journal(spark, sf_dir).mood_overview, "mean", "sd", "first_mood", "last_mood", "best_mood", "worst_mood", "net")


def journal_span(spark, sf_dir):
    return shown(journal(spark, sf_dir).span)


def recurring_problems(spark, sf_dir):
    return shown(journal(spark, sf_dir).recurring.where("rank <= 8"))


def half_trend(spark, sf_dir):
    return journal(spark, sf_dir).half_counts.where("rank <= 8").drop("rank")


def cooccurring_concepts(spark, sf_dir):
    return journal(spark, sf_dir).cooccurring


def never_with_coping(spark, sf_dir):
    return journal(spark, sf_dir).never_with_coping.select("participant_id", "concept_id", "days")


def two_hop_chains(spark, sf_dir):
    return journal(spark, sf_dir).chains


def recurring_chains(spark, sf_dir):
    return journal(spark, sf_dir).recurring_chains.drop("total_days")


def coping_mood_delta(spark, sf_dir):
    return shown(journal(spark, sf_dir).coping_mood_delta, "mood_with", "baseline", "delta")


def next_day_mood(spark, sf_dir):
    return shown(journal(spark, sf_dir).next_day_mood, "mood", "next_mood", "shift")


def coping_next_day(spark, sf_dir):
    return shown(journal(spark, sf_dir).coping_next_day, "mean_shift")


def coping_targets(spark, sf_dir):
    return journal(spark, sf_dir).coping_targets


def weekday_low_mood(spark, sf_dir):
    return shown(journal(spark, sf_dir).weekday_low_mood, "mean", "baseline")


def weekday_stressor_cluster(spark, sf_dir):
    return journal(spark, sf_dir).weekday_stressor_cluster


def weekday_name(spark, sf_dir):
    return shown(journal(spark, sf_dir).entries.select("sample_id", "entry_date", F.date_format("entry_date", "EEEE").alias("weekday")))


def discussion_points(spark, sf_dir):
    return journal(spark, sf_dir).discussion_points.select("participant_id", "rank", "key", "strength", "text")


def day_reference(spark, sf_dir):
    return shown(journal(spark, sf_dir).day_reference, "mood_score")


def day_normalise(spark, sf_dir):
    return shown(journal(spark, sf_dir).day_normalise, "value")


def day_diff(spark, sf_dir):
    return journal(spark, sf_dir).day_diff


def concept_streaks(spark, sf_dir):
    return journal(spark, sf_dir).concept_streaks


def previous_day_context(spark, sf_dir):
    return journal(spark, sf_dir).previous_day_context


QUERIES = {f.__name__: f for f in [
    classify_problem_coping, first_seen_meta, concept_days, mood_per_date, mood_series, mood_overview, journal_span,
    recurring_problems, half_trend, cooccurring_concepts, never_with_coping, two_hop_chains, recurring_chains,
    coping_mood_delta, next_day_mood, coping_next_day, coping_targets, weekday_low_mood, weekday_stressor_cluster,
    weekday_name, discussion_points, day_reference, day_normalise, day_diff, concept_streaks, previous_day_context,
]}
