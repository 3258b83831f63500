"""Graph operators on long node and edge tables.

Pairs of nodes are counted from type counts, found from edges, or drawn by
sampling; they are never listed, so a graph of n nodes costs n, not n squared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daygraph import constants as C
from daygraph.functions.columns import pick, ratio, rows

POLARITIES = ["negative", "positive", "neutral", "mixed"]


def edge_endpoints(nodes: DataFrame, edges: DataFrame, keep_self: bool = False) -> DataFrame:
    """Edges with both end nodes; dangling edges drop out, self-edges unless kept."""
    ends = ["node_id", "concept_id", "type", "label", "polarity", "pos"]
    src = nodes.select("sample_id", *[F.col(c).alias(f"source_{c}") for c in ends])
    dst = nodes.select("sample_id", *[F.col(c).alias(f"target_{c}") for c in ends])
    real = edges if keep_self else edges.where(F.col("source_node_id") != F.col("target_node_id"))
    return real.join(src, ["sample_id", "source_node_id"]).join(dst, ["sample_id", "target_node_id"])


def connected_pairs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Unordered node pairs joined by at least one edge; ids order as strings."""
    swap = F.col("source_node_id") > F.col("target_node_id")
    side = lambda name, first: F.when(swap == F.lit(first), F.col(f"target_{name}")).otherwise(F.col(f"source_{name}"))
    cols = ["node_id", "type", "polarity", "concept_id", "pos"]
    both = edge_endpoints(nodes, edges).select(
        "sample_id",
        *[side(c, True).alias(f"{c}_a") for c in cols],
        *[side(c, False).alias(f"{c}_b") for c in cols],
    )
    same = [f"{c}_{s}" for s in "ab" for c in cols]
    return both.groupBy("sample_id", *same).agg(rows().alias("n_edges"))


def type_pair(a: str = "type_a", b: str = "type_b") -> tuple[Column, Column]:
    return F.least(a, b), F.greatest(a, b)


def pair_counts(nodes: DataFrame) -> DataFrame:
    """Node pairs per sample and unordered type pair, from the type counts alone."""
    counts = nodes.groupBy("sample_id", "type").agg(rows().alias("n"))
    per_sample = counts.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("type", "n"))).alias("c"))
    pairs = F.expr(
        "flatten(transform(c, (x, i) -> transform(slice(c, i + 1, size(c)), y -> named_struct("
        "'type_a', x.type, 'type_b', y.type, "
        "'n_pairs', IF(x.type = y.type, x.n * (x.n - 1) DIV 2, x.n * y.n)))))"
    )
    return (
        per_sample.select("sample_id", F.explode(pairs).alias("p"))
        .select("sample_id", "p.*").where(F.col("n_pairs") > 0)
    )


def pair_balance(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per sample and type pair: all pairs, connected pairs, negative candidates."""
    lo, hi = type_pair()
    joined = connected_pairs(nodes, edges).groupBy("sample_id", lo.alias("type_a"), hi.alias("type_b")).agg(
        rows().alias("n_connected")
    )
    return (
        pair_counts(nodes).join(joined, ["sample_id", "type_a", "type_b"], "left")
        .withColumn("n_connected", F.coalesce("n_connected", F.lit(0)).cast("long"))
        .withColumn("n_candidates", F.col("n_pairs") - F.col("n_connected"))
    )


def typepair_connectivity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Co-occurring and connected pairs with P(connected) per unordered type pair."""
    lo, hi = type_pair()
    co = pair_counts(nodes).groupBy("type_a", "type_b").agg(F.sum("n_pairs").alias("cooccur"))
    con = connected_pairs(nodes, edges).groupBy(lo.alias("type_a"), hi.alias("type_b")).agg(rows().alias("connected"))
    return (
        co.join(con, ["type_a", "type_b"], "left")
        .withColumn("connected", F.coalesce("connected", F.lit(0)).cast("long"))
        .withColumn("p", ratio(F.col("connected"), F.col("cooccur"), 0.0))
    )


def band_flag(stats: DataFrame, min_count: int, strict: bool = True) -> DataFrame:
    """``ok``/``OUT`` inside the open band, or ``OK``/``DEGEN`` inside the closed band; blank if rare."""
    low, high = C.BAND
    p = F.col("p")
    inside = (p > low) & (p < high) if strict else (p >= low) & (p <= high)
    good, bad = ("ok", "OUT") if strict else ("OK", "DEGEN")
    return stats.withColumn(
        "flag", F.when(F.col("cooccur") < min_count, "").when(inside, good).otherwise(bad)
    )


def verbalise_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edge as "label wording label"."""
    words = F.create_map(*[F.lit(x) for kv in C.RELATION_WORDS.items() for x in kv])
    word = F.coalesce(F.try_element_at(words, F.col("edge_type")), F.col("edge_type"))
    return edge_endpoints(nodes, edges, keep_self=True).select(
        "sample_id", "edge_id", F.concat_ws(" ", "source_label", word, "target_label").alias("relation")
    )


def signature(kind: Column, polarity: Column) -> Column:
    """Index of (type, polarity) in the closed list of both."""
    t = F.array_position(F.array(*[F.lit(x) for x in C.NODE_TYPES]), kind)
    p = F.array_position(F.array(*[F.lit(x) for x in POLARITIES]), polarity)
    return ((t - 1) * len(POLARITIES) + p - 1).cast("int")


def ordered_pair_counts(nodes: DataFrame, chunk: int = 4096) -> DataFrame:
    """Pairs (earlier node, later node) per pair of signatures, linear in the nodes.

    Inside a chunk of positions a running count per signature is kept; whole
    earlier chunks enter by their totals, so no window grows beyond a chunk.
    """
    n_sig = len(C.NODE_TYPES) * len(POLARITIES)
    tagged = nodes.select("sample_id", "pos", signature(F.col("type"), F.col("polarity")).alias("sig"), F.floor((F.col("pos") - 1) / chunk).alias("chunk"))
    running = Window.partitionBy("sample_id", "chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    before = F.array(*[F.coalesce(F.sum((F.col("sig") == i).cast("int")).over(running), F.lit(0)) for i in range(n_sig)])
    inside = tagged.select("sig", before.alias("before"))
    inside = inside.select(F.posexplode("before").alias("sig_a", "n"), F.col("sig").alias("sig_b"))

    totals = tagged.groupBy("sample_id", "chunk").agg(
        F.array(*[F.sum((F.col("sig") == i).cast("int")) for i in range(n_sig)]).alias("here")
    )
    chunks = Window.partitionBy("sample_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.array(*[F.coalesce(F.sum(F.col("here")[i]).over(chunks), F.lit(0)) for i in range(n_sig)])
    across = totals.withColumn("before", earlier).where("chunk > 0")
    across = (
        across.select("here", F.posexplode("before").alias("sig_a", "m")).where("m > 0")
        .select("sig_a", "m", F.posexplode("here").alias("sig_b", "k"))
        .select("sig_a", "sig_b", (F.col("m") * F.col("k")).alias("n"))
    )
    return (
        inside.select("sig_a", "sig_b", "n").where("n > 0").unionByName(across.where("n > 0"))
        .groupBy("sig_a", "sig_b").agg(F.sum("n").cast("long").alias("n_pairs"))
    )


def compat_relation(nodes: DataFrame, edges: DataFrame, chunk: int = 4096) -> DataFrame:
    """Plausible relation of the unconnected pairs, by (type, polarity) of the earlier and later node."""
    pairs = connected_pairs(nodes, edges)
    first = F.col("pos_a") < F.col("pos_b")
    pick_side = lambda c, early: F.when(first == F.lit(early), F.col(f"{c}_a")).otherwise(F.col(f"{c}_b"))
    sig = lambda early: signature(pick_side("type", early), pick_side("polarity", early))
    joined = pairs.select(sig(True).alias("sig_a"), sig(False).alias("sig_b")).groupBy("sig_a", "sig_b").agg(
        rows().alias("n_connected")
    )
    free = (
        ordered_pair_counts(nodes, chunk).join(joined, ["sig_a", "sig_b"], "left")
        .withColumn("n_unconnected", F.col("n_pairs") - F.coalesce("n_connected", F.lit(0)))
        .where("n_unconnected > 0")
    )
    width = len(POLARITIES)
    free = free.select(
        pick(C.NODE_TYPES, F.floor(F.col("sig_a") / width)).alias("type_a"), pick(POLARITIES, F.col("sig_a") % width).alias("polarity_a"),
        pick(C.NODE_TYPES, F.floor(F.col("sig_b") / width)).alias("type_b"), pick(POLARITIES, F.col("sig_b") % width).alias("polarity_b"),
        "n_unconnected",
    )
    forward = refined_relation("a", "b")
    backward = refined_relation("b", "a")
    is_forward, any_way = forward.isNotNull(), F.coalesce(forward, backward)
    return free.select(
        "*", any_way.alias("relation"),
        F.when(is_forward, F.col("type_a")).when(backward.isNotNull(), F.col("type_b")).alias("source_type"),
        F.when(is_forward, F.col("type_b")).when(backward.isNotNull(), F.col("type_a")).alias("target_type"),
    )


def refined_relation(src: str, dst: str) -> Column:
    """Table lookup on the types, then the polarity rule."""
    flat = {f"{s}|{t}": rel for s, t, rel in C.PLAUSIBLE_RELATION}
    table = F.create_map(*[F.lit(x) for kv in flat.items() for x in kv])
    base = F.try_element_at(table, F.concat_ws("|", f"type_{src}", f"type_{dst}"))
    sp, tp = F.col(f"polarity_{src}"), F.col(f"polarity_{dst}")
    opposite = ((sp == "positive") & (tp == "negative")) | ((sp == "negative") & (tp == "positive"))
    alike = sp.isin("positive", "negative") & (sp == tp)
    return (
        F.when(base.isNull(), F.lit(None))
        .when(F.col(f"type_{src}") == "coping_action", F.when(tp == "negative", "decreases").otherwise("causes"))
        .when(base.isin("increases", "decreases") & opposite, "decreases")
        .when(base.isin("increases", "decreases") & alike, "increases")
        .otherwise(base)
    )


def relation_majority(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Most frequent relation per ordered type pair; ties by name."""
    counts = edge_endpoints(nodes, edges, keep_self=True).groupBy(
        F.col("source_type").alias("src_type"), F.col("target_type").alias("dst_type"),
        F.coalesce("edge_type", F.lit(C.DEFAULT_RELATION)).alias("relation"),
    ).agg(rows().alias("n"))
    best = Window.partitionBy("src_type", "dst_type").orderBy(F.desc("n"), "relation")
    return counts.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")


def relation_pick(pairs: DataFrame, relations: DataFrame) -> DataFrame:
    """Direction and relation for (type_a, type_b): the reverse only if its count is larger."""
    fwd = relations.select(F.col("src_type").alias("type_a"), F.col("dst_type").alias("type_b"),
                           F.col("relation").alias("_fr"), F.col("n").alias("_fn"))
    rev = relations.select(F.col("src_type").alias("type_b"), F.col("dst_type").alias("type_a"),
                           F.col("relation").alias("_rr"), F.col("n").alias("_rn"))
    fn, rn = F.coalesce("_fn", F.lit(0)), F.coalesce("_rn", F.lit(0))
    back = rn > fn
    return (
        pairs.join(fwd, ["type_a", "type_b"], "left").join(rev, ["type_a", "type_b"], "left")
        .withColumn("src_type", F.when(back, F.col("type_b")).otherwise(F.col("type_a")))
        .withColumn("dst_type", F.when(back, F.col("type_a")).otherwise(F.col("type_b")))
        .withColumn("reversed", back)
        .withColumn("relation", F.when(back, F.col("_rr")).otherwise(F.coalesce("_fr", F.lit(C.DEFAULT_RELATION))))
        .drop("_fr", "_fn", "_rr", "_rn")
    )


def concept_lookup(ids: DataFrame, pool: DataFrame) -> DataFrame:
    """Concept metadata with the unknown default."""
    meta = pool.select("concept_id", F.col("type").alias("_t"), F.col("label").alias("_l"), F.col("polarity").alias("_p"))
    return ids.join(meta, "concept_id", "left").select(
        *ids.columns, F.coalesce("_t", F.lit("unknown")).alias("type"),
        F.coalesce("_l", "concept_id").alias("label"), F.coalesce("_p", F.lit("neutral")).alias("polarity"),
    )


def day_polarity(nodes: DataFrame) -> DataFrame:
    """Positive minus negative emotion and symptom nodes per sample."""
    sign = F.when(F.col("polarity") == "positive", 1).when(F.col("polarity") == "negative", -1).otherwise(0)
    felt = F.when(F.col("type").isin("emotion", "symptom"), sign).otherwise(0)
    return nodes.groupBy("sample_id").agg(F.sum(felt).cast("long").alias("day_polarity"))


def node_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Incident edges per node; a self-edge counts twice."""
    ends = edges.select("sample_id", F.explode(F.array("source_node_id", "target_node_id")).alias("node_id"))
    degree = ends.groupBy("sample_id", "node_id").agg(rows().alias("degree"))
    return nodes.select("sample_id", "node_id").join(degree, ["sample_id", "node_id"], "left").select(
        "sample_id", "node_id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree")
    )


def droppable_edges(edges: DataFrame) -> DataFrame:
    """Edges whose both ends keep another edge."""
    ends = edges.select("sample_id", F.explode(F.array("source_node_id", "target_node_id")).alias("node_id"))
    busy = ends.groupBy("sample_id", "node_id").agg(rows().alias("n")).where("n > 1").select("sample_id", "node_id")
    return edges.select("sample_id", "edge_id", "source_node_id", "target_node_id").join(
        busy.withColumnRenamed("node_id", "source_node_id"), ["sample_id", "source_node_id"], "left_semi"
    ).join(
        busy.withColumnRenamed("node_id", "target_node_id"), ["sample_id", "target_node_id"], "left_semi"
    )


def unresolved_nodes(nodes: DataFrame) -> DataFrame:
    """Negative nodes that may carry over: not anchored in the past."""
    return nodes.where(
        F.col("type").isin("stressor", "symptom", "emotion", "event")
        & (F.col("polarity") == "negative") & (F.col("day_offset") >= 0)
    )
