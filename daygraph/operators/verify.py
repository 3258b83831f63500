"""Verification scoring, the accept/review/reject gate and run bookkeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daygraph import constants as C
from daygraph.functions import text as X
from daygraph.functions.columns import count_if, ratio, rows

def last_verdict(verdicts: DataFrame, key: str, flags: list[str]) -> DataFrame:
    """Last verdict per id and how often the verifier named it.

    Order and exact-true flags share one number, so the maximum is a plain hash aggregate.
    """
    size = 1 << len(flags)
    bits = sum((F.when(F.col(f), 1 << i).otherwise(0) for i, f in enumerate(flags)), F.lit(0))
    last = verdicts.groupBy("sample_id", key).agg(F.max(F.col("ord") * size + bits).alias("_last"), rows().alias("n_verdicts"))
    return last.select("sample_id", key, *[(F.col("_last").bitwiseAND(1 << i) > 0).alias(f) for i, f in enumerate(flags)], "n_verdicts")


def judged_nodes(nodes: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Gold nodes with verdict flags; only an exact true counts."""
    last = last_verdict(verdicts, "node_id", ["mentioned", "temporal_correct"])
    return nodes.join(last, ["sample_id", "node_id"], "left").withColumns({
        "mentioned": F.coalesce("mentioned", F.lit(False)),
        "temporal_correct": F.coalesce("temporal_correct", F.lit(False)),
        "n_verdicts": F.coalesce("n_verdicts", F.lit(0)),
    })


def judged_edges(edges: DataFrame, verdicts: DataFrame) -> DataFrame:
    last = last_verdict(verdicts, "edge_id", ["expressed"])
    return edges.join(last, ["sample_id", "edge_id"], "left").withColumns({
        "expressed": F.coalesce("expressed", F.lit(False)), "n_verdicts": F.coalesce("n_verdicts", F.lit(0)),
    })


def completeness(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Judged ids whose verdict count is not one."""
    part = lambda df, key, kind: df.where("n_verdicts <> 1").select(
        "sample_id", F.lit(kind).alias("kind"), F.col(key).alias("id"), F.col("n_verdicts").cast("long").alias("n_verdicts")
    )
    return part(nodes, "node_id", "node").unionByName(part(edges, "edge_id", "edge"))


def scores(samples: DataFrame, nodes: DataFrame, edges: DataFrame, extras: DataFrame) -> DataFrame:
    """Coverage, hallucination and confidence per sample; unparsed verifier output scores zero.

    ``extras`` has ``sample_id, n`` (extra content items found).
    """
    by_node = nodes.groupBy("sample_id").agg(
        rows().alias("nodes_total"), count_if(F.col("mentioned")).alias("nodes_mentioned"),
        count_if(F.col("temporal_correct")).alias("nodes_timed"), count_if(F.col("n_verdicts") != 1).alias("bad_nodes"),
    )
    by_edge = edges.groupBy("sample_id").agg(
        rows().alias("edges_total"), count_if(F.col("expressed")).alias("edges_expressed"),
        count_if(F.col("n_verdicts") != 1).alias("bad_edges"),
    )
    ok = F.col("parsed")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    found = lambda c: F.when(ok, zero(c)).otherwise(0).cast("long")
    joined = samples.select("sample_id", "language", "scenario", "parsed").join(by_node, "sample_id", "left").join(
        by_edge, "sample_id", "left").join(extras.select("sample_id", F.col("n").alias("_extra")), "sample_id", "left")
    counted = joined.select(
        "sample_id", "language", "scenario", "parsed", zero("nodes_total").alias("nodes_total"), found("nodes_mentioned").alias("nodes_mentioned"),
        found("nodes_timed").alias("nodes_timed"), zero("edges_total").alias("edges_total"),
        found("edges_expressed").alias("edges_expressed"), found("_extra").alias("hallucination_count"),
        found("bad_nodes").alias("bad_nodes"), found("bad_edges").alias("bad_edges"),
    )
    return with_shares(counted)


def with_shares(counted: DataFrame) -> DataFrame:
    """Coverage, hallucination score and confidence from the counts of a sample, to four places.

    Confidence weighs the exact shares; the gate sees the rounded ones.
    """
    ok = F.col("parsed")
    share = lambda top, total: F.when(ok, ratio(F.col(top), F.col(total), 1.0)).otherwise(0.0)
    w = C.CONFIDENCE_WEIGHTS
    limit = C.MAX_COUNTED_EXTRAS
    shares = ["node_coverage", "edge_coverage", "temporal_consistency"]
    return counted.withColumns({
        "node_coverage": share("nodes_mentioned", "nodes_total"),
        "edge_coverage": share("edges_expressed", "edges_total"),
        "temporal_consistency": share("nodes_timed", "nodes_total"),
        "hallucination_score": F.bround(F.when(ok, F.least("hallucination_count", F.lit(limit)) / float(limit)).otherwise(1.0), 4),
    }).withColumn("overall_confidence", F.bround(F.when(
        ok, w["node"] * F.col("node_coverage") + w["edge"] * F.col("edge_coverage")
        + w["time"] * F.col("temporal_consistency") + w["clean"] * (1.0 - F.col("hallucination_score"))
    ).otherwise(0.0), 4)).withColumns({c: F.bround(c, 4) for c in shares})


def decide(gates: dict | None = None) -> Column:
    """Gate cascade; a verifier that failed or was incomplete forces a reject."""
    gates = gates or C.GATES
    passed = lambda g: (
        (F.col("node_coverage") >= g["node"]) & (F.col("edge_coverage") >= g["edge"])
        & (F.col("temporal_consistency") >= g["time"]) & (F.col("hallucination_count") <= g["extra"])
    )
    sound = F.col("parsed") & (F.col("bad_nodes") + F.col("bad_edges") == 0)
    return F.when(~sound, "reject").when(passed(gates["accept"]), "accept").when(passed(gates["review"]), "review").otherwise("reject")


def decisions(scored: DataFrame, gates: dict | None = None) -> DataFrame:
    return scored.withColumn("decision", decide(gates))


def offsets(nodes: DataFrame) -> DataFrame:
    """Distinct day offsets per sample (three values at most)."""
    return nodes.select("sample_id", "day_offset").distinct().groupBy("sample_id").agg(
        F.collect_set("day_offset").alias("offsets"))


def time_extras(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per sample, the time references its graph does not license. Texts are read where they are; what meets the graph is their time words."""
    said = texts.withColumn("low", F.lower("text")).select(
        "sample_id", "language", X.time_words(F.col("text"), F.col("low"), F.col("language")).alias("_said"))
    known = F.coalesce("offsets", F.array().cast("array<int>"))
    return said.join(offsets(nodes), "sample_id", "left").select("sample_id", "language", X.unlicensed(F.col("_said"), known).alias("time_extras"))


def merge_extras(named: Column, timed: Column) -> Column:
    """Trimmed non-blank verifier items, then each time reference no earlier item contains or is contained in."""
    trimmed = F.transform(named, lambda x: F.struct(F.trim(x["content"]).alias("content"), F.trim(F.coalesce(x["evidence"], F.lit(""))).alias("evidence")))
    kept = F.filter(trimmed, lambda x: x["content"] != "")
    overlaps = lambda acc, t: F.exists(acc, lambda e: (
        F.contains(F.lower(e["content"]), F.lower(t["content"])) | F.contains(F.lower(t["content"]), F.lower(e["content"]))))
    return F.aggregate(timed, kept, lambda acc, t: F.when(overlaps(acc, t), acc).otherwise(F.concat(acc, F.array(t))))


ISSUES = ("node", "relation", "timing", "extra")


def reasons(scored: DataFrame, nodes: DataFrame, edges: DataFrame, extras: DataFrame) -> DataFrame:
    """Why a record was decided as it was, as rows: one head per sample, then one row per issue.

    ``nodes`` and ``edges`` are judged; ``extras`` has ``sample_id, contents``. A head
    has kind ``decision``, place 0 and the counts of all issues in its sentence; the
    shape is the same at every size. Accepted records and those whose verifier
    failed have a head only.
    """
    row = lambda kind, ord_, item: ["sample_id", F.lit(kind).alias("kind"), F.col(ord_).cast("long").alias("ord"), item.alias("item")]
    labels = nodes.select("sample_id", "node_id", "label")
    silent = edges.where("NOT expressed").join(
        labels.withColumnsRenamed({"node_id": "source_node_id", "label": "_s"}), ["sample_id", "source_node_id"]).join(
        labels.withColumnsRenamed({"node_id": "target_node_id", "label": "_t"}), ["sample_id", "target_node_id"])
    issues = nodes.where("NOT mentioned").select(*row("node", "pos", F.col("label"))).unionByName(
        silent.select(*row("relation", "edge_no", F.concat("_s", F.lit("->"), "_t")))).unionByName(
        nodes.where("mentioned AND NOT temporal_correct").select(*row("timing", "pos", F.format_string("%s (expected '%s')", "label", "anchor")))).unionByName(
        extras.select("sample_id", F.posexplode("contents").alias("p", "c")).select(*row("extra", "p", F.col("c"))))
    counts = issues.groupBy("sample_id").agg(*[count_if(F.col("kind") == k).alias(f"n_{k}") for k in ISSUES])
    n = {k: F.coalesce(f"n_{k}", F.lit(0)).cast("string") for k in ISSUES}
    head = (
        F.when(~F.col("parsed"), "verifier output unreadable")
        .when(F.col("bad_nodes") + F.col("bad_edges") > 0, F.concat(
            F.lit("verifier output incomplete, ids without exactly one verdict: "), F.col("bad_nodes").cast("string"), F.lit(" nodes, "),
            F.col("bad_edges").cast("string"), F.lit(" edges")))
        .when(F.col("decision") == "accept", F.concat(
            F.lit("complete: "), F.col("nodes_total").cast("string"), F.lit(" nodes, "), F.col("edges_total").cast("string"), F.lit(" relations")))
        .otherwise(F.concat(
            F.lit("unclear nodes: "), n["node"], F.lit(", silent relations: "), n["relation"],
            F.lit(", wrong times: "), n["timing"], F.lit(", extras: "), n["extra"])))
    heads = scored.join(counts, "sample_id", "left").select(
        "sample_id", "decision", F.lit("decision").alias("kind"), F.lit(0).cast("long").alias("ord"), head.alias("item"))
    told = scored.where("parsed AND bad_nodes + bad_edges = 0 AND decision <> 'accept'").select("sample_id", "decision")
    return heads.unionByName(issues.join(told, "sample_id").select("sample_id", "decision", "kind", "ord", "item"))


def decision_breakdown(decided: DataFrame) -> DataFrame:
    """Counts and rates overall, by language and by scenario."""
    counts = [count_if(F.col("decision") == d).alias(f"n_{d}") for d in C.DECISIONS]
    sets = decided.groupingSets([[], ["language"], ["scenario"]], "language", "scenario").agg(
        F.grouping_id().alias("gid"), rows().alias("n"), *counts)
    facet = F.when(F.col("gid") == 3, "all").when(F.col("gid") == 1, "language").otherwise("scenario")
    rates = [ratio(F.col(f"n_{d}"), F.col("n"), 0.0).alias(f"{d}_rate") for d in C.DECISIONS]
    return sets.select(
        facet.alias("facet"), F.coalesce("language", "scenario", F.lit("all")).alias("value"),
        "n", *[f"n_{d}" for d in C.DECISIONS], *rates,
    )


def mean_scores(decided: DataFrame, samples: DataFrame) -> DataFrame:
    parts = ["node_coverage", "edge_coverage", "temporal_consistency", "hallucination_score", "overall_confidence"]
    who = samples.select("sample_id", "participant_id", "day_index")
    return decided.join(who, "sample_id").agg(
        *[F.avg(p).alias(p) for p in parts], count_if(F.col("hallucination_count") > 0).alias("samples_with_extras"),
        F.countDistinct("participant_id").alias("participants"), F.countDistinct("day_index").alias("days"), rows().alias("samples"),
    )


def usage_ledger(records: DataFrame, full_samples: int) -> DataFrame:
    """Token totals, cost by price, cost per sample and its linear extrapolation."""
    cost = (F.col("prompt_tokens") / 1e6 * C.PROMPT_PRICE) + (F.col("completion_tokens") / 1e6 * C.COMPLETION_PRICE)
    totals = records.agg(
        *[F.sum(c).cast("long").alias(c) for c in ("prompt_tokens", "completion_tokens", "llm_calls")], rows().alias("samples"))
    return totals.withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens")).withColumn(
        "cost_usd", cost).withColumn("cost_per_sample", ratio(F.col("cost_usd"), F.col("samples"), 0.0)).withColumn(
        "extrapolated_usd", F.col("cost_per_sample") * full_samples)


def row_digest(*cols: str) -> tuple[Column, Column]:
    """Both halves of the row's MD5 as numbers, for sums that do not depend on order."""
    digest = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in cols]))
    return tuple(F.conv(F.substring(digest, at, 16), 16, 10).cast("decimal(38,0)") for at in (1, 17))


NODE_FIELDS = ["pos", "node_id", "concept_id", "type", "label", "polarity", "anchor", "day_offset", "temporal_status", "confidence"]
EDGE_FIELDS = ["edge_no", "edge_id", "source_node_id", "target_node_id", "edge_type", "weight"]


def graph_hash(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """SHA-1 per graph over its rows' digests: one pass with partial sums, no sorting, no collecting."""
    def part(df, fields, tag):
        high, low = row_digest(*fields)
        return df.select("sample_id", F.lit(tag).alias("tag"), high.alias("h"), low.alias("l"))
    both = part(nodes, NODE_FIELDS, "n").unionByName(part(edges, EDGE_FIELDS, "e"))
    only = lambda tag, value: F.coalesce(F.sum(F.when(F.col("tag") == tag, value)), F.lit(0)).cast("decimal(38,0)")
    fields = {f"{tag}{name}": only(tag, value) for tag in "ne" for name, value in (("", F.lit(1)), ("h", F.col("h")), ("l", F.col("l")))}
    sums = both.groupBy("sample_id").agg(*[value.alias(name) for name, value in fields.items()])
    return sums.select("sample_id", F.sha1(F.concat_ws(":", *[F.col(c).cast("string") for c in fields])).alias("graph_hash"))


def graph_drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """``sample_id, version, graph_hash`` of two runs: what is missing, new or changed."""
    o = old.select("sample_id", F.col("version").alias("_ov"), F.col("graph_hash").alias("_oh"))
    n = new.select("sample_id", F.col("version").alias("_nv"), F.col("graph_hash").alias("_nh"))
    state = (
        F.when(F.col("_nh").isNull(), "missing").when(F.col("_oh").isNull(), "new")
        .when(F.col("_ov") != F.col("_nv"), "version").when(F.col("_oh") != F.col("_nh"), "content").otherwise("same")
    )
    return o.join(n, "sample_id", "full").select("sample_id", state.alias("state"))


def pick_examples(records: DataFrame) -> DataFrame:
    """First sample per (language, style group), preferring accept, then review; no sample twice."""
    group = F.when(F.col("writing_style").isin(C.SHORT_STYLES), "short").when(F.col("writing_style").isin(C.LONG_STYLES), "long")
    pref = F.array_position(F.array(*[F.lit(d) for d in C.DECISIONS]), F.col("decision"))
    best = records.withColumn("style_group", group).where(F.col("style_group").isNotNull()).groupBy("language", "style_group").agg(
        F.min(F.struct(pref.alias("pref"), F.col("participant_id"), F.col("day_index"), F.col("sample_id"), F.col("decision"))).alias("m"))
    picked = best.select("language", "style_group", "m.sample_id", "m.decision")
    order = Window.partitionBy("sample_id").orderBy(F.desc("language"), F.desc("style_group"))
    return picked.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def expectation_checks(measured: DataFrame, expected: dict[str, int]) -> DataFrame:
    """``field, measured`` against literal expectations."""
    table = F.create_map(*[x for k, v in expected.items() for x in (F.lit(k), F.lit(v).cast("long"))])
    want = F.try_element_at(table, F.col("field"))
    return measured.select("field", "measured", want.alias("expected"), F.when(F.col("measured") == want, "PASS").otherwise("FAIL").alias("verdict"))
