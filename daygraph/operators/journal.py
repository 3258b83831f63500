"""Journals over time: recurrence, chains, coping, mood, streaks and day-to-day change.

All per-participant work starts from distinct (participant, concept, date) rows,
which are bounded by calendar and vocabulary, however many entries a journal has.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daygraph import constants as C
from daygraph.functions.columns import count_if, r6, ratio, rows
from daygraph.functions.ranking import grouped_row_number
from daygraph.operators.graph import edge_endpoints

PID = "participant_id"


def is_problem() -> Column:
    return F.col("type").isin(C.PROBLEM_TYPES) & (F.col("polarity") != "positive")


def is_coping() -> Column:
    return (F.col("type") == "coping_action") | ((F.col("type") == "activity") & (F.col("polarity") == "positive"))


def ranked(df: DataFrame, keys: list[str], order: list, limit: int | None = None) -> DataFrame:
    """Rank small, already aggregated groups."""
    out = df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = out if limit is None else out.where(F.col("rank") <= limit)
    return kept.withColumn("rank", F.col("rank").cast("long"))


class Journal:
    """Longitudinal tables of many participants.

    ``entries``: sample_id, participant_id, entry_date, mood_score, eligible
    (enough text). ``nodes`` and ``edges`` are the long graph tables.
    """

    def __init__(self, entries: DataFrame, nodes: DataFrame, edges: DataFrame):
        self.entries, self.nodes, self.edges = entries, nodes, edges

    def with_tables(self, keep) -> "Journal":
        """Write the tables that many sections share, so that each is made once. ``keep(df, name)``."""
        for name in ("first_seen_meta", "concept_dates", "days", "recurring", "chains", "recurring_chains", "coping"):
            self.__dict__[name] = keep(getattr(self, name), name)
        return self

    # -- shared indexes ----------------------------------------------------

    @cached_property
    def dated_nodes(self) -> DataFrame:
        dates = self.entries.select("sample_id", "entry_date")
        return self.nodes.drop("entry_date").join(dates, "sample_id")

    @cached_property
    def first_seen_meta(self) -> DataFrame:
        """Type, label and polarity from the first sighting by date, entry and node order."""
        seen = F.struct("entry_date", "sample_id", "pos")
        meta = F.struct("type", F.coalesce("label", "concept_id").alias("label"), F.coalesce("polarity", F.lit("neutral")).alias("polarity"))
        return self.dated_nodes.groupBy(PID, "concept_id").agg(F.min_by(meta, seen).alias("m")).select(PID, "concept_id", "m.*")

    @cached_property
    def concept_dates(self) -> DataFrame:
        return self.dated_nodes.select(PID, "concept_id", "entry_date").distinct()

    @cached_property
    def days(self) -> DataFrame:
        """Distinct dates with their mood (first scored entry of the date) and half of the period."""
        scored = F.when(F.col("mood_score").isNotNull(), F.struct("sample_id", "mood_score"))
        day = self.entries.groupBy(PID, "entry_date").agg(F.min(scored)["mood_score"].alias("mood"), rows().alias("n_entries"))
        ordered = Window.partitionBy(PID).orderBy("entry_date")
        whole = Window.partitionBy(PID)
        return day.withColumn("day_no", F.row_number().over(ordered)).withColumn("total_days", F.count(F.lit(1)).over(whole)).withColumn(
            "first_half", F.col("day_no") <= F.floor(F.col("total_days") / 2)).withColumn("previous", F.lag("entry_date").over(ordered))

    @cached_property
    def span(self) -> DataFrame:
        """Entries, distinct days, span and the longest gap with the date before it."""
        gap = F.datediff("entry_date", "previous")
        widest = F.max(F.when(gap.isNotNull(), F.struct(gap.alias("gap"), (-F.datediff("previous", F.lit("1970-01-01").cast("date"))).alias("k"), F.col("previous"))))
        return self.days.groupBy(PID).agg(
            F.sum("n_entries").cast("long").alias("entries"), rows().alias("total_days"), F.min("entry_date").alias("first_date"),
            F.max("entry_date").alias("last_date"), widest.alias("w")).select(
            PID, "entries", "total_days", "first_date", "last_date",
            (F.datediff("last_date", "first_date") + 1).cast("long").alias("span_days"),
            (F.col("w.gap") - 1).cast("long").alias("gap_days"), F.when(F.col("w.gap") > 1, F.col("w.previous")).alias("gap_after"))

    @cached_property
    def moods(self) -> DataFrame:
        return self.days.where("mood IS NOT NULL").select(PID, "entry_date", "mood")

    @cached_property
    def baseline(self) -> DataFrame:
        """Mean mood of participants with at least two scored dates."""
        return self.moods.groupBy(PID).agg(F.avg("mood").alias("baseline"), rows().alias("n_moods")).where("n_moods >= 2")

    @cached_property
    def concept_days(self) -> DataFrame:
        return self.concept_dates.groupBy(PID, "concept_id").agg(
            rows().alias("days"), F.min("entry_date").alias("first_date"), F.max("entry_date").alias("last_date"))

    @cached_property
    def known_concepts(self) -> DataFrame:
        return self.concept_days.join(self.first_seen_meta, [PID, "concept_id"]).join(self.span.select(PID, "total_days"), PID)

    # -- problems ----------------------------------------------------------

    @cached_property
    def recurring(self) -> DataFrame:
        """Problem concepts on at least the threshold number of days, most frequent first."""
        threshold = F.when(F.col("total_days") < 5, 2).otherwise(F.greatest(F.lit(3), F.ceil(0.2 * F.col("total_days")))).cast("long")
        kept = self.known_concepts.where(is_problem()).withColumn("threshold", threshold).where("days >= threshold")
        return ranked(kept, [PID], [F.desc("days"), "concept_id"])

    @cached_property
    def cooccurring(self) -> DataFrame:
        """Other concepts on the days of the eight top problems: two or more days, five at most."""
        top = self.recurring.where("rank <= 8").select(PID, "concept_id")
        mine = self.concept_dates.join(top, [PID, "concept_id"])
        others = self.concept_dates.withColumnRenamed("concept_id", "other_id")
        pairs = mine.join(others, [PID, "entry_date"]).where("other_id <> concept_id")
        counts = pairs.groupBy(PID, "concept_id", "other_id").agg(rows().alias("days")).where("days >= 2")
        return ranked(counts, [PID, "concept_id"], [F.desc("days"), "other_id"], 5)

    @cached_property
    def half_counts(self) -> DataFrame:
        """Days in the first and second half of the period for every recurring problem."""
        mine = self.concept_dates.join(self.recurring.select(PID, "concept_id", "days", "total_days", "rank"), [PID, "concept_id"])
        halves = mine.join(self.days.select(PID, "entry_date", "first_half"), [PID, "entry_date"])
        counts = halves.groupBy(PID, "concept_id", "days", "total_days", "rank").agg(count_if(F.col("first_half")).alias("first_days"))
        second = F.col("days") - F.col("first_days")
        trend = F.when(second > F.col("first_days"), "increasing").when(second < F.col("first_days"), "decreasing").otherwise("stable")
        return counts.where("total_days >= 4").withColumn("second_days", second).withColumn("trend", trend)

    @cached_property
    def coping_dates(self) -> DataFrame:
        coping = self.first_seen_meta.where(is_coping()).select(PID, "concept_id")
        return self.concept_dates.join(coping, [PID, "concept_id"], "left_semi").select(PID, "entry_date").distinct()

    @cached_property
    def never_with_coping(self) -> DataFrame:
        """Recurring problems that share no day with coping, where there is coping at all."""
        shared = self.concept_dates.join(self.coping_dates, [PID, "entry_date"], "left_semi").select(PID, "concept_id").distinct()
        some = self.coping_dates.select(PID).distinct()
        return self.recurring.join(some, PID, "left_semi").join(shared, [PID, "concept_id"], "left_anti")

    # -- chains ------------------------------------------------------------

    @cached_property
    def chains(self) -> DataFrame:
        """First 50 two-hop paths over three distinct concepts per entry.

        Every first edge that has a continuation starts at least one path, so only the
        first 50 of them per entry can matter, and per (middle node, last concept) only
        the first 50 second edges. Those limits apply before the shuffle and the join.
        """
        cap = C.CHAIN_PATHS_PER_ENTRY
        edge = edge_endpoints(self.nodes, self.edges, keep_self=True).where("source_concept_id <> target_concept_id").select(
            "sample_id", "edge_no", "source_node_id", "target_node_id", "source_pos", "source_concept_id", "target_concept_id", "edge_type")
        out_all = edge.groupBy("sample_id", F.col("source_node_id").alias("middle")).agg(rows().alias("n_out"))
        out_to = edge.groupBy("sample_id", F.col("source_node_id").alias("middle"), F.col("target_concept_id").alias("a")).agg(rows().alias("n_back"))
        first = edge.select(
            "sample_id", "source_pos", F.col("edge_no").alias("e1"), F.col("target_node_id").alias("middle"),
            F.col("source_concept_id").alias("a"), F.col("target_concept_id").alias("b"), F.col("edge_type").alias("relation_1"))
        alive = first.join(out_all, ["sample_id", "middle"]).join(out_to, ["sample_id", "middle", "a"], "left").where(
            F.col("n_out") > F.coalesce("n_back", F.lit(0)))
        in_order = Window.partitionBy("sample_id").orderBy("source_pos", "e1")
        opening = alive.withColumn("_n", F.row_number().over(in_order)).where(F.col("_n") <= cap).drop("_n", "n_out", "n_back")
        ending = Window.partitionBy("sample_id", "middle", "c").orderBy("e2")
        second = edge.select(
            "sample_id", F.col("edge_no").alias("e2"), F.col("source_node_id").alias("middle"), F.col("target_concept_id").alias("c"),
            F.col("edge_type").alias("relation_2")).withColumn("_n", F.row_number().over(ending)).where(F.col("_n") <= cap).drop("_n")
        paths = opening.join(second, ["sample_id", "middle"]).where("c <> a")
        order = Window.partitionBy("sample_id").orderBy("source_pos", "e1", "e2")
        numbered = paths.withColumn("path_no", F.row_number().over(order)).where(F.col("path_no") <= cap)
        return numbered.select("sample_id", F.col("path_no").cast("long").alias("path_no"), "a", "b", "c", "relation_1", "relation_2")

    @cached_property
    def recurring_chains(self) -> DataFrame:
        """Chains by distinct days (two, or one in a short journal); relations as first seen."""
        where = self.entries.select("sample_id", PID, "entry_date")
        seen = F.struct("entry_date", "sample_id", "path_no")
        counts = self.chains.join(where, "sample_id").groupBy(PID, "a", "b", "c").agg(
            F.countDistinct("entry_date").alias("days"), F.min_by(F.struct("relation_1", "relation_2"), seen).alias("r"))
        kept = counts.select(PID, "a", "b", "c", "days", "r.*").join(self.span.select(PID, "total_days"), PID).where(
            F.col("days") >= F.when(F.col("total_days") < 5, 1).otherwise(2))
        return ranked(kept, [PID], [F.desc("days"), "a", "b", "c"], 5)

    # -- coping ------------------------------------------------------------

    @cached_property
    def coping(self) -> DataFrame:
        """Coping concepts seen on two or more days."""
        kept = self.known_concepts.where(is_coping() & (F.col("days") >= 2))
        return ranked(kept, [PID], [F.desc("days"), "concept_id"])

    @cached_property
    def coping_moods(self) -> DataFrame:
        return self.concept_dates.join(self.coping.select(PID, "concept_id"), [PID, "concept_id"], "left_semi").join(self.moods, [PID, "entry_date"])

    @cached_property
    def coping_mood_delta(self) -> DataFrame:
        """Mood on coping days against the baseline; needs two scored days."""
        with_it = self.coping_moods.groupBy(PID, "concept_id").agg(F.avg("mood").alias("_avg"), rows().alias("_n"))
        joined = self.coping.select(PID, "concept_id", "days").join(with_it, [PID, "concept_id"], "left").join(self.baseline.drop("n_moods"), PID, "left")
        enough = F.col("baseline").isNotNull() & (F.col("_n") >= 2)
        delta = F.when(enough, F.col("_avg") - F.col("baseline"))
        return joined.select(
            PID, "concept_id", "days", F.coalesce("_n", F.lit(0)).cast("long").alias("n"), F.when(enough, F.col("_avg")).alias("mood_with"),
            "baseline", delta.alias("delta"),
            F.when(delta.isNull(), "not enough data").when(F.abs(delta) < 0.3, "no association").otherwise("association").alias("verdict"))

    @cached_property
    def next_day_mood(self) -> DataFrame:
        """Mood shift to the next calendar day, where that day is scored too."""
        after = self.moods.select(PID, F.date_sub("entry_date", 1).alias("entry_date"), F.col("mood").alias("next_mood"))
        return self.moods.join(after, [PID, "entry_date"]).withColumn("shift", F.col("next_mood") - F.col("mood"))

    @cached_property
    def coping_next_day(self) -> DataFrame:
        coping = self.coping.select(PID, "concept_id")
        shifts = self.concept_dates.join(coping, [PID, "concept_id"], "left_semi").join(self.next_day_mood, [PID, "entry_date"])
        return shifts.groupBy(PID, "concept_id").agg(F.avg("shift").alias("mean_shift"), rows().alias("n")).where("n >= 2")

    @cached_property
    def coping_targets(self) -> DataFrame:
        """Targets of coping edges: relief edges if there are any, else all edges, five at most."""
        ends = edge_endpoints(self.nodes, self.edges).where("source_concept_id <> target_concept_id").select(
            F.col(PID), F.col("source_concept_id").alias("concept_id"), F.col("target_concept_id").alias("target_id"), "edge_type")
        counts = ends.groupBy(PID, "concept_id", "target_id").agg(
            rows().alias("n_any"), count_if(F.col("edge_type").isin(C.RELIEF_EDGE_TYPES)).alias("n_relief"))
        mine = self.coping.select(PID, "concept_id").join(counts, [PID, "concept_id"], "left")
        per = Window.partitionBy(PID, "concept_id")
        relief = F.coalesce(F.sum("n_relief").over(per), F.lit(0)) > 0
        kind = F.when(F.col("target_id").isNull(), "none").when(relief, "relief").otherwise("any")
        n = F.when(kind == "relief", F.col("n_relief")).otherwise(F.coalesce("n_any", F.lit(0))).cast("long")
        rowset = mine.select(PID, "concept_id", kind.alias("kind"), F.coalesce("target_id", F.lit("")).alias("target_id"), n.alias("n"))
        return ranked(rowset.where("n > 0 OR kind = 'none'"), [PID, "concept_id"], [F.desc("n"), "target_id"], 5)

    # -- mood and weekdays -------------------------------------------------

    @cached_property
    def mood_overview(self) -> DataFrame:
        m = F.struct("mood", (-F.datediff("entry_date", F.lit("1970-01-01").cast("date"))).alias("k"))
        low = F.struct("mood", "entry_date")
        stats = self.moods.groupBy(PID).agg(
            rows().alias("n_moods"), F.avg("mood").alias("mean"), F.stddev_pop("mood").alias("sd"), F.min_by("mood", "entry_date").alias("first_mood"),
            F.max_by("mood", "entry_date").alias("last_mood"), F.max_by("entry_date", m).alias("best_date"), F.max("mood").alias("best_mood"),
            F.min_by("entry_date", low).alias("worst_date"), F.min("mood").alias("worst_mood")).where("n_moods >= 2")
        net = F.col("last_mood") - F.col("first_mood")
        return stats.withColumns({
            "net": net, "direction": F.when(net > 0.5, "up").when(net < -0.5, "down").otherwise("flat"),
            "volatility": F.when(F.col("sd") < 0.8, "low").when(F.col("sd") < 1.6, "moderate").otherwise("high")})

    @cached_property
    def weekday_low_mood(self) -> DataFrame:
        """Weekdays with two or more moods a full point below the baseline; needs six moods."""
        per_day = self.moods.groupBy(PID, F.date_format("entry_date", "EEEE").alias("weekday")).agg(F.avg("mood").alias("mean"), rows().alias("n"))
        return per_day.join(self.baseline.where("n_moods >= 6").drop("n_moods"), PID).where("n >= 2 AND baseline - mean >= 1.0")

    @cached_property
    def weekday_stressor_cluster(self) -> DataFrame:
        """Weekday that holds 40 % or more of the stressor days."""
        stressors = self.first_seen_meta.where("type = 'stressor'").select(PID, "concept_id")
        counts = self.concept_dates.join(stressors, [PID, "concept_id"], "left_semi").groupBy(
            PID, F.date_format("entry_date", "EEEE").alias("weekday")).agg(rows().alias("n"))
        per = Window.partitionBy(PID)
        top = ranked(counts.withColumn("total", F.sum("n").over(per)).withColumn("weekdays", F.count(F.lit(1)).over(per)), [PID], [F.desc("n"), "weekday"], 1)
        return top.join(self.span.select(PID, "total_days"), PID).where(
            "total >= 6 AND total_days >= 7 AND weekdays > 1 AND n >= total * 0.4D").select(PID, "weekday", "n", "total")

    # -- discussion points -------------------------------------------------

    @cached_property
    def discussion_points(self) -> DataFrame:
        """Five signals with their strength, the five strongest per participant."""
        label = self.first_seen_meta.select(PID, "concept_id", "label")
        num = lambda c: F.col(c).cast("string")
        say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
        per_total = lambda c: F.col(c) / F.col("total_days")
        growing = self.half_counts.where("second_days >= first_days * 1.5D AND second_days - first_days >= 2").join(label, [PID, "concept_id"]).select(
            PID, F.lit(1).alias("kind"), F.col("concept_id").alias("key"), (F.col("second_days") - F.col("first_days") + per_total("days")).alias("strength"),
            say("**", F.col("label"), "** grew from the first to the second half (", num("first_days"), " → ", num("second_days"),
                " days). What was different later?").alias("text"))
        alone = self.never_with_coping.select(
            PID, F.lit(2).alias("kind"), F.col("concept_id").alias("key"), (per_total("days") + 0.5).alias("strength"),
            say("**", F.col("label"), "** (", num("days"), " days) never met a coping action. What has been tried?").alias("text"))
        name = lambda c: label.select(PID, F.col("concept_id").alias(c), F.col("label").alias(f"label_{c}"))
        chain = self.recurring_chains.where("rank = 1 AND days >= 2").join(name("a"), [PID, "a"]).join(name("b"), [PID, "b"]).join(name("c"), [PID, "c"]).select(
            PID, F.lit(3).alias("kind"), F.concat_ws("→", "a", "b", "c").alias("key"), (per_total("days") + 0.4).alias("strength"),
            say("Chain **", F.concat_ws(" → ", "label_a", "label_b", "label_c"), "** came back on ", num("days"),
                " days. Where could it be broken?").alias("text"))
        low = self.weekday_low_mood.select(
            PID, F.lit(4).alias("kind"), F.col("weekday").alias("key"), ((F.col("baseline") - F.col("mean")) / 2).alias("strength"),
            say("**", F.col("weekday"), "s** have mood ", fixed1(F.col("mean")), " vs ", fixed1(F.col("baseline")), " overall (", num("n"), " ", F.col("weekday"),
                "s). What does that weekday bring?").alias("text"))
        cluster = self.weekday_stressor_cluster.select(
            PID, F.lit(5).alias("kind"), F.col("weekday").alias("key"), ratio(F.col("n"), F.col("total")).alias("strength"),
            say("Stressors gather on **", F.col("weekday"), "s** (", num("n"), " of ", num("total"), "). What fills that day?").alias("text"))
        union = growing.unionByName(alone).unionByName(chain).unionByName(low).unionByName(cluster).withColumn("strength", r6(F.col("strength")))
        return ranked(union, [PID], [F.desc("strength"), "kind", "key"], 5)

    # -- per entry ---------------------------------------------------------

    @cached_property
    def numbered(self) -> DataFrame:
        """Entries in date and path order with a running number per participant."""
        day = F.datediff("entry_date", F.lit("1970-01-01").cast("date"))
        return grouped_row_number(self.entries, [PID], ["entry_date", "sample_id"], day, "entry_no")

    @cached_property
    def day_reference(self) -> DataFrame:
        """Mood and the five most confident distinct known concepts per entry."""
        known = self.nodes.where("type <> 'unknown'").groupBy("sample_id", "concept_id").agg(
            F.max(F.struct(F.coalesce("confidence", F.lit(0.0)).alias("confidence"), (-F.col("pos")).alias("k"), F.coalesce("label", "concept_id").alias("label"))).alias("m"))
        top = ranked(known.select("sample_id", "m.*"), ["sample_id"], [F.desc("confidence"), F.desc("k")], 5)
        joined = top.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("rank", "label"))).alias("t"))
        text = F.array_join(F.transform("t", lambda x: x["label"]), ", ")
        return self.entries.join(joined, "sample_id", "left").select(
            PID, "sample_id", "entry_date", "mood_score", F.coalesce(text, F.lit("—")).alias("top_concepts"))

    @cached_property
    def best_nodes(self) -> DataFrame:
        """Most confident node per concept and entry, the earlier one on a tie."""
        return self.nodes.groupBy("sample_id", "concept_id").agg(
            F.max(F.struct(F.coalesce("confidence", F.lit(0.0)).alias("value"), (-F.col("pos")).alias("k"), "node_id")).alias("m")).select(
            "sample_id", F.col("concept_id").alias("key"), "m.value", F.col("m.node_id").alias("id"))

    @cached_property
    def best_edges(self) -> DataFrame:
        """Heaviest edge per (from, to, relation) and entry between different concepts."""
        ends = edge_endpoints(self.nodes, self.edges).where("source_concept_id <> target_concept_id")
        key = F.concat("source_concept_id", F.lit("→"), "target_concept_id", F.lit(":"), "edge_type")
        return ends.groupBy("sample_id", key.alias("key")).agg(F.max(F.coalesce("weight", F.lit(0.5))).alias("value"))

    @cached_property
    def day_normalise(self) -> DataFrame:
        return self.best_nodes.withColumn("kind", F.lit("node")).unionByName(
            self.best_edges.withColumn("kind", F.lit("edge")).withColumn("id", F.lit("")))

    @cached_property
    def day_diff(self) -> DataFrame:
        """Each entry with enough text against the entry right before it."""
        place = self.numbered.where("eligible").select("sample_id", PID, "entry_no")
        marks = self.best_nodes.select("sample_id", "key", F.lit("node").alias("kind")).unionByName(
            self.best_edges.select("sample_id", "key", F.lit("edge").alias("kind"))).join(place, "sample_id")
        now = marks.select(PID, "entry_no", "kind", "key", F.lit(1).alias("here"), F.lit(0).alias("before"))
        earlier = marks.select(PID, F.col("entry_no") + 1, "kind", "key", F.lit(0), F.lit(1)).toDF(*now.columns)
        seen = now.unionByName(earlier).groupBy(PID, "entry_no", "kind", "key").agg(F.max("here").alias("here"), F.max("before").alias("before"))
        node, edge = F.col("kind") == "node", F.col("kind") == "edge"
        both, only, gone = (F.col("here") + F.col("before") == 2), (F.col("before") == 0), (F.col("here") == 0)
        counts = seen.groupBy(PID, "entry_no").agg(
            count_if(node & only).alias("added"), count_if(node & both).alias("recurring"),
            count_if(node & gone).alias("removed"), count_if(edge & only).alias("new_edges"))
        prior = place.select(PID, (F.col("entry_no") + 1).alias("entry_no"), F.lit(True).alias("has_prior"))
        joined = place.join(prior, [PID, "entry_no"], "left").join(counts, [PID, "entry_no"], "left")
        shown = lambda c: F.when(F.col("has_prior"), F.coalesce(c, F.lit(0))).otherwise(0).cast("long").alias(c)
        return joined.select("sample_id", PID, "entry_no", F.col("has_prior").isNull().alias("first_day"),
                             shown("added"), shown("recurring"), shown("removed"), shown("new_edges"))

    @cached_property
    def concept_streaks(self) -> DataFrame:
        """Run length of each concept over consecutive entries, 61 at most.

        Entry numbers are cut into blocks of 61; each block also sees the one
        before it, which covers the whole look-back, so windows stay small.
        """
        size = C.STREAK_CAP
        place = self.numbered.where("eligible").select("sample_id", "entry_no")
        seen = self.nodes.select("sample_id", PID, "concept_id").distinct().join(place, "sample_id")
        home = F.floor(F.col("entry_no") / size)
        spread = seen.withColumn("home", home).withColumn("block", F.explode(F.array(home, home + 1)))
        per = Window.partitionBy(PID, "concept_id", "block").orderBy("entry_no")
        island = spread.withColumn("island", F.col("entry_no") - F.row_number().over(per))
        start = F.min("entry_no").over(Window.partitionBy(PID, "concept_id", "block", "island"))
        return island.withColumn("streak", F.least(F.lit(size), F.col("entry_no") - start + 1).cast("long")).where("home = block").select(
            "sample_id", "concept_id", "streak")

    @cached_property
    def previous_day_context(self) -> DataFrame:
        """Flags of the entry before: a future event, coping, low mood."""
        flags = self.nodes.groupBy("sample_id").agg(
            F.max(F.col("temporal_status") == "future").alias("future"), F.max(F.col("type") == "coping_action").alias("coping"))
        placed = self.numbered.join(flags, "sample_id", "left").select(
            PID, "entry_no", "sample_id", F.coalesce("future", F.lit(False)).alias("had_future"), F.coalesce("coping", F.lit(False)).alias("had_coping"),
            F.coalesce(F.col("mood_score") < 4.5, F.lit(False)).alias("low_mood"))
        prior = placed.select(PID, (F.col("entry_no") + 1).alias("entry_no"), "had_future", "had_coping", "low_mood")
        return placed.select(PID, "entry_no", "sample_id").join(prior, [PID, "entry_no"], "left").select(
            "sample_id", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("had_future", "had_coping", "low_mood")])


def fixed1(value: Column) -> Column:
    """One decimal as text; null stays null."""
    return F.when(value.isNotNull(), F.format_string("%.1f", F.round(r6(value), 1) + F.lit(0.0)))


def signed1(value: Column) -> Column:
    shown = F.round(r6(value), 1) + F.lit(0.0)
    return F.when(value.isNotNull(), F.concat(F.when(r6(value) >= 0, "+").otherwise(""), F.when((r6(value) < 0) & (shown == 0), "-0.0").otherwise(F.format_string("%.1f", shown))))
