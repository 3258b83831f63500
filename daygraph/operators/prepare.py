"""Train/dev/test tables: splits, labels and sampled node pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daygraph import constants as C
from daygraph.functions.columns import count_if, ratio, rows
from daygraph.functions.ranking import (
    bucketed_prefix_sum,
    expand_counts,
    grouped_row_number,
    range_rank,
    hash_bucket,
    hash_order,
)
from daygraph.operators.graph import connected_pairs, pair_counts
from daygraph.session import written

#: Rounds of the keyed permutation of pair numbers: as many as it takes until pairs of draws are even on a graph of four nodes.
ROUNDS = 12
#: Halves of pair numbers up to which a graph's digests are made once and looked up by its draws.
SMALL_HALF = 64


def stratified_split(participants: DataFrame, ratios: dict[str, float] | None = None, seed: int = C.SEED) -> DataFrame:
    """Participant to split inside each language: rounded shares in a seeded order, the rest to test."""
    ratios = ratios or C.SPLIT_RATIOS
    if abs(sum(ratios.values()) - 1.0) > 1e-6:
        raise ValueError(f"split ratios must sum to 1, got {sum(ratios.values())}")
    hashed = participants.select("participant_id", "language").withColumn("_h", hash_order(seed, "language", "participant_id"))
    placed = grouped_row_number(hashed, ["language"], ["_h", "participant_id"], hash_bucket("_h"), "_r")
    sizes = participants.groupBy("language").agg(rows().alias("_n"))
    n_train = F.bround(F.col("_n") * ratios["train"], 0)
    n_dev = F.bround(F.col("_n") * ratios["dev"], 0)
    split = F.when(F.col("_r") <= n_train, "train").when(F.col("_r") <= n_train + n_dev, "dev").otherwise("test")
    return placed.join(sizes, "language").select("participant_id", "language", split.alias("split"))


def assign_split(df: DataFrame, splits: DataFrame) -> DataFrame:
    """Rows of known participants with their split."""
    return df.join(splits.select("participant_id", "split"), "participant_id")


def sample_labels(nodes: DataFrame) -> DataFrame:
    return nodes.select("sample_id", "concept_id").distinct()


def node_examples(samples: DataFrame, nodes: DataFrame, with_texts: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Text with its sorted distinct labels; label sets are bounded by the vocabulary. ``with_texts`` adds ``text``, last, to samples that have their labels."""
    labels = nodes.select("sample_id", "concept_id", "label").distinct().groupBy("sample_id").agg(
        F.array_sort(F.collect_set("concept_id")).alias("labels"), F.array_sort(F.collect_set("label")).alias("label_surface"))
    return with_texts(samples.withColumn("num_nodes", F.col("n_nodes")).join(labels, "sample_id")).select(
        "sample_id", "participant_id", "day_index", "language", "num_nodes", "labels", "label_surface", "text")


def label_index(train_labels: DataFrame, common_min: int = C.COMMON_LABEL_MIN) -> DataFrame:
    """Support and dense name-ordered index of the train labels."""
    support = train_labels.groupBy("concept_id").agg(rows().alias("train_support"))
    return range_rank(support, ["concept_id"], "idx").withColumn("is_common", F.col("train_support") >= common_min)


def unseen_labels(labels: DataFrame, index: DataFrame) -> DataFrame:
    return labels.join(index.select("concept_id"), "concept_id", "left_anti")


def split_checks(splits: DataFrame, examples: DataFrame, index: DataFrame, common_min: int = C.COMMON_LABEL_MIN) -> DataFrame:
    """Disjointness of the map and of the examples, language share spread, support of common labels."""
    def overlap(df, name):
        twice = df.groupBy("participant_id").agg(F.countDistinct("split").alias("s")).where("s > 1")
        return twice.agg(rows().cast("double").alias("value")).select(F.lit(name).alias("rule"), "value", (F.col("value") == 0).alias("ok"))
    share = examples.groupBy("split").agg(ratio(count_if(F.col("language") == "en"), rows(), 0.0).alias("en"))
    spread = share.agg((F.max("en") - F.min("en")).alias("value")).select(
        F.lit("language share spread").alias("rule"), "value", (F.col("value") < C.SHARE_SPREAD_LIMIT).alias("ok"))
    weak = index.where(F.col("is_common") & (F.col("train_support") < common_min)).agg(rows().cast("double").alias("value")).select(
        F.lit("common labels below minimum").alias("rule"), "value", (F.col("value") == 0).alias("ok"))
    return overlap(splits, "map disjoint").unionByName(overlap(examples, "examples disjoint")).unionByName(spread).unionByName(weak)


def type_pair_key(a: str = "type_a", b: str = "type_b") -> Column:
    return F.concat_ws("__", F.least(a, b), F.greatest(a, b))


def positives(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Connected pairs with positions in order, ids in string order."""
    return connected_pairs(nodes, edges).select(
        "sample_id", F.least("pos_a", "pos_b").alias("lo"), F.greatest("pos_a", "pos_b").alias("hi"),
        F.col("node_id_a").alias("node_a"), F.col("node_id_b").alias("node_b"), type_pair_key().alias("type_pair"), "type_a", "type_b")


def hex_number(digest: Column, start: int, length: int) -> Column:
    return F.conv(F.substring(digest, start, length), 16, 10).cast("long")


def unrank(index: Column) -> tuple[Column, Column]:
    """The ``index``-th unordered pair (low, high), zero-based, in order of the high end."""
    guess = F.floor((F.sqrt(index.cast("double") * 8 + 1) + 1) / 2).cast("long")
    high = F.when(guess * (guess - 1) / 2 > index, guess - 1).when(guess * (guess + 1) / 2 <= index, guess + 1).otherwise(guess)
    return (index - F.floor(high * (high - 1) / 2)).cast("long"), high.cast("long")


def with_nodes(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Node ids and type pair for position pairs."""
    side = lambda p, s: nodes.select("sample_id", F.col("pos").alias(p), F.col("node_id").alias(f"_i{s}"), F.col("type").alias(f"_t{s}"))
    return pairs.join(side("lo", 1), ["sample_id", "lo"]).join(side("hi", 2), ["sample_id", "hi"]).select(
        *pairs.columns, F.least("_i1", "_i2").alias("node_a"), F.greatest("_i1", "_i2").alias("node_b"),
        type_pair_key("_t1", "_t2").alias("type_pair"))


def permuted_numbers(plan: DataFrame, keys: list[str], draws: str, total: str, seed: int) -> DataFrame:
    """Rows of ``plan`` times ``draw, number``: at least ``draws`` different numbers below ``total`` in a keyed random order.

    The order is a permutation of all numbers of the next power of two: a Feistel network whose halves are
    added to by digests of the key, the round and the other half. Numbers from ``total`` on are passed over,
    fewer than half of them. So many places are looked at that ``draws`` numbers are found: all of them
    where there are few, else twelve standard deviations more than is expected. A short half has few values,
    so their digests are made once per row of ``plan``, not per number.
    """
    bits = F.length(F.bin(F.col(total) - 1))
    left = F.floor(bits / 2).cast("int")
    power = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), n)
    sized = plan.withColumns({"_pl": power(left), "_pr": power(bits - left)})
    expected = F.col(draws) * (F.col("_pl") * F.col("_pr")).cast("double") / F.col(total)
    places = F.least(F.col("_pl") * F.col("_pr"), F.ceil(expected + 12 * F.sqrt(expected)) + 64)
    turns = [("_l", "_r", "_pl", "_pr") if k % 2 == 0 else ("_r", "_l", "_pr", "_pl") for k in range(ROUNDS)]
    digest = lambda k, x: hex_number(F.md5(F.concat_ws(":", F.lit(str(seed)), *keys, F.lit(str(k)), x.cast("string"))), 1, 8)
    table = lambda k, size: F.when(F.col(size) <= SMALL_HALF, F.transform(F.sequence(F.lit(0).cast("long"), F.col(size) - 1), lambda x: digest(k, x)))
    known = {f"_d{k}": table(k, other) for k, (_, _, _, other) in enumerate(turns)}
    spread = expand_counts(sized.withColumn("_places", F.when(F.col(draws) > 0, places).otherwise(0)), keys, "_places", "draw", also=known)
    spread = spread.withColumns({"_l": F.expr("draw DIV _pr"), "_r": F.expr("draw % _pr")})
    for k, (to, by, size, _) in enumerate(turns):
        told = F.when(F.col(f"_d{k}").isNotNull(), F.get(f"_d{k}", F.col(by).cast("int"))).otherwise(digest(k, F.col(by)))
        spread = spread.withColumn(to, (F.col(to) + told) % F.col(size))
    # An exploded array of one keeps the filter from being moved below the rounds, where each would be computed many times.
    number = F.explode(F.array(F.col("_l") * F.col("_pr") + F.col("_r")))
    return spread.withColumn("number", number).where(F.col("number") < F.col(total)).drop("_pl", "_pr", "_places", "_l", "_r", *known)


def most_draws(plan: DataFrame, draws: Column) -> DataFrame:
    """``n``: no more numbers come from ``permuted_numbers`` for a row of ``plan`` (it looks at fewer than two places a draw, and some more)."""
    return plan.select((2 * draws + 12 * F.sqrt(2 * draws) + 65).alias("n"))


def negatives_random(nodes: DataFrame, edges: DataFrame, neg_ratio: float = 1.0, seed: int = C.SEED, pos: DataFrame | None = None) -> DataFrame:
    """Per graph ``min(candidates, round(positives * ratio))`` unconnected pairs.

    Pair numbers of a graph come in a keyed random order without repeats. With K wanted
    and P positives the first K + P of them hold at least K negatives, and the first K
    negatives are a uniform draw: the work follows the edges, not the pairs. ``pos``: the positives, where they are written.
    """
    pos = positives(nodes, edges) if pos is None else pos
    size = nodes.groupBy("sample_id").agg(rows().alias("n"))
    counts = pos.groupBy("sample_id").agg(rows().alias("p")).join(size, "sample_id")
    total = F.floor(F.col("n") * (F.col("n") - 1) / 2).cast("long")
    plan = counts.withColumn("total", total).withColumn(
        "want", F.least(F.col("total") - F.col("p"), F.bround(F.col("p") * F.lit(float(neg_ratio)), 0).cast("long"))).withColumn(
        "draws", F.when(F.col("want") > 0, F.col("want") + F.col("p")).otherwise(0))
    plan = written(plan, "draw-plan")
    drawn = permuted_numbers(plan, ["sample_id"], "draws", "total", seed).withColumnRenamed("number", "index")
    low, high = unrank(F.col("index"))
    pairs = drawn.select("sample_id", "want", "draw", (low + 1).alias("lo"), (high + 1).alias("hi"))
    free = pairs.join(pos.select("sample_id", "lo", "hi"), ["sample_id", "lo", "hi"], "left_anti")
    kept = grouped_row_number(free, ["sample_id"], ["draw"], F.floor(F.col("draw") / 65_536), "_r", most=most_draws(plan, F.col("draws"))).where("_r <= want")
    return with_nodes(kept.select("sample_id", "lo", "hi"), nodes)


def union_pos_neg(pos: DataFrame, neg: DataFrame) -> DataFrame:
    cols = ["sample_id", "lo", "hi", "node_a", "node_b", "type_pair"]
    return pos.select(*cols, F.lit(True).alias("connected")).unionByName(neg.select(*cols, F.lit(False).alias("connected"))).withColumn(
        "example_id", F.concat_ws("__", "sample_id", "node_a", "node_b"))


def largest_remainder(counts: DataFrame, keys: list[str], neg_ratio: float) -> DataFrame:
    """Integer targets per type pair proportional to ``n_pos`` that sum to the rounded total."""
    per = Window.partitionBy(*keys)
    whole = counts.withColumn("_all", F.sum("n_pos").over(per)).withColumn(
        "_goal", F.bround(F.col("_all") * F.lit(float(neg_ratio)), 0).cast("long"))
    product = F.col("_goal") * F.col("n_pos")
    base = whole.withColumn("_base", F.expr("(_goal * n_pos) DIV _all")).withColumn("_rest", product % F.col("_all"))
    missing = F.col("_goal") - F.sum("_base").over(per)
    order = F.row_number().over(per.orderBy(F.desc("_rest"), "type_pair"))
    return base.withColumn("target", (F.col("_base") + F.when(order <= missing, 1).otherwise(0)).cast("long")).select(*counts.columns, "target")


def fill_plan(targets: dict[str, int], pools: dict[str, int]) -> tuple[dict[str, int], dict[str, int]]:
    """How many negatives each type pair gives, and how many of them stand in for others.

    A pure rule over at most 28 counts. Own pools first; then each short type pair,
    in name order, drains the pools that share a node type, largest first, then the rest.
    """
    left = dict(pools)
    take = {}
    for name in sorted(targets):
        take[name] = min(targets[name], left.get(name, 0))
        left[name] = left.get(name, 0) - take[name]
    stand_in: dict[str, int] = {}
    for name in sorted(targets):
        need = targets[name] - take[name]
        if need <= 0:
            continue
        kinds = set(name.split("__"))
        ranking = sorted((p for p in left if left[p] > 0), key=lambda p: (not kinds & set(p.split("__")), -left[p], p))
        for other in ranking:
            moved = min(need, left[other])
            left[other] -= moved
            need -= moved
            stand_in[other] = stand_in.get(other, 0) + moved
            if need == 0:
                break
    total = {p: take.get(p, 0) + stand_in.get(p, 0) for p in pools | take}
    return total, stand_in


PLAN_SCHEMA = T.StructType([
    T.StructField("split", T.StringType()), T.StructField("type_pair", T.StringType()), T.StructField("n_pos", T.LongType()),
    T.StructField("target", T.LongType()), T.StructField("pool", T.LongType()), T.StructField("take", T.LongType()),
    T.StructField("stand_in", T.LongType()), T.StructField("deficit", T.LongType())])


def hard_plan(nodes: DataFrame, edges: DataFrame, neg_ratio: float = 1.0, pos: DataFrame | None = None) -> DataFrame:
    """Negatives to take per split and type pair. ``nodes`` carry ``split``.

    The counts are collected: nodes of the closed list of 7 types count, so at most
    28 type pairs per split come to the driver. ``pos``: the positives, where they are written.
    """
    nodes = nodes.where(F.col("type").isin(*C.NODE_TYPES))
    split_of = nodes.select("sample_id", "split").distinct()
    pairs = pair_counts(nodes).withColumn("type_pair", type_pair_key()).join(split_of, "sample_id").groupBy("split", "type_pair").agg(F.sum("n_pairs").alias("n_pairs"))
    known = (positives(nodes, edges) if pos is None else pos).where(F.col("type_a").isin(*C.NODE_TYPES) & F.col("type_b").isin(*C.NODE_TYPES))
    pos = known.join(split_of, "sample_id").groupBy("split", "type_pair").agg(rows().alias("n_pos"))
    targets = largest_remainder(pos, ["split"], neg_ratio)
    counted = pairs.join(targets, ["split", "type_pair"], "left").select(
        "split", "type_pair", F.coalesce("n_pos", F.lit(0)).alias("n_pos"), F.coalesce("target", F.lit(0)).alias("target"),
        (F.col("n_pairs") - F.coalesce("n_pos", F.lit(0))).alias("pool")).collect()
    out = []
    for split in sorted({r.split for r in counted}):
        mine = [r for r in counted if r.split == split]
        take, stand_in = fill_plan({r.type_pair: r.target for r in mine if r.n_pos}, {r.type_pair: r.pool for r in mine})
        out += [(split, r.type_pair, r.n_pos, r.target, r.pool, take[r.type_pair], stand_in.get(r.type_pair, 0), max(0, r.target - r.pool)) for r in mine]
    return nodes.sparkSession.createDataFrame(out, PLAN_SCHEMA)


def negatives_hard(nodes: DataFrame, edges: DataFrame, plan: DataFrame, seed: int = C.SEED, pos: DataFrame | None = None) -> DataFrame:
    """Unconnected pairs per split and type pair, as many as ``plan`` takes, uniform over the pool.

    The pairs of a type pair are numbered over all graphs by prefix sums of the
    pair counts; keyed draws of those numbers (``permuted_numbers``) are mapped to a graph by an
    interval join (cells of like size share blocks, about 17 candidates per
    probe) and then to two nodes. Pools are never listed. ``pos``: the positives, where they are written.
    """
    split_of = nodes.select("sample_id", "split").distinct()
    kinds = nodes.groupBy("sample_id", "type").agg(rows().alias("n"))
    pos = positives(nodes, edges) if pos is None else pos
    cells = pair_counts(nodes).join(split_of, "sample_id").withColumn("type_pair", type_pair_key()).withColumn("_h", F.md5("sample_id"))
    keys = ["split", "type_pair"]
    cells = bucketed_prefix_sum(cells, keys, ["_h", "sample_id"], hash_bucket("_h"), "n_pairs", "start")
    level = F.ceil(F.log2(F.col("n_pairs").cast("double")) / 4).cast("int")
    width = F.expr("shiftleft(1L, level * 4)")
    big = F.col("level") >= 4
    spots = cells.withColumn("level", level).withColumn("width", width).withColumn(
        "block", F.explode(F.array_distinct(F.array(F.floor(F.col("start") / F.col("width")), F.floor((F.col("start") + F.col("n_pairs") - 1) / F.col("width")))))).withColumn(
        "salt", F.explode(F.when(big, F.sequence(F.lit(0), F.lit(63))).otherwise(F.array(F.lit(0)))))

    totals = cells.groupBy(*keys).agg(F.sum("n_pairs").alias("total"), F.collect_set(level).alias("levels"))
    draws = plan.where("take > 0").join(totals, keys).withColumn("draws", F.col("take") + F.col("n_pos"))
    drawn = permuted_numbers(draws, keys, "draws", "total", seed)
    probes = drawn.select(*keys, "take", "draw", "number", F.explode("levels").alias("level")).withColumn(
        "block", F.floor(F.col("number") / width)).withColumn("salt", F.when(big, (F.col("draw") % 64).cast("int")).otherwise(0))
    # Spark takes expanded rows for as few as they came from and would broadcast the probes: both sides are sorted.
    hit = probes.hint("merge").join(spots.select(*keys, "level", "block", "salt", "sample_id", "start", "n_pairs", "type_a", "type_b"), [*keys, "level", "block", "salt"]).where(
        "number >= start AND number < start + n_pairs").withColumn("local", F.col("number") - F.col("start"))
    hit = hit.join(kinds.select("sample_id", F.col("type").alias("type_b"), F.col("n").alias("n_b")), ["sample_id", "type_b"])
    low, high = unrank(F.col("local"))
    same = F.col("type_a") == F.col("type_b")
    hit = hit.withColumn("rank_a", F.when(same, low).otherwise(F.expr("local DIV n_b")) + 1).withColumn(
        "rank_b", F.when(same, high).otherwise(F.col("local") % F.col("n_b")) + 1)
    placed = grouped_row_number(nodes.select("sample_id", "type", "pos"), ["sample_id", "type"], ["pos"], F.floor(F.col("pos") / 65_536), "rank")
    side = lambda s: placed.select("sample_id", F.col("type").alias(f"type_{s}"), F.col("rank").alias(f"rank_{s}"), F.col("pos").alias(f"_p{s}"))
    pairs = hit.join(side("a"), ["sample_id", "type_a", "rank_a"]).join(side("b"), ["sample_id", "type_b", "rank_b"]).select(
        *keys, "take", "draw", "sample_id", F.least("_pa", "_pb").alias("lo"), F.greatest("_pa", "_pb").alias("hi"))
    free = pairs.join(pos.select("sample_id", "lo", "hi"), ["sample_id", "lo", "hi"], "left_anti")
    kept = grouped_row_number(free, keys, ["draw"], F.floor(F.col("draw") / 65_536), "_r", most=most_draws(plan, F.col("take") + F.col("n_pos"))).where("_r <= take")
    return with_nodes(kept.select("split", "sample_id", "lo", "hi"), nodes)


def tv_distance(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Per type pair the share of positives and negatives, and half the summed gap per key.

    ``counts``: keys, type_pair, n_pos, n_neg.
    """
    per = Window.partitionBy(*keys)
    shares = counts.withColumn("pos_share", ratio(F.col("n_pos"), F.sum("n_pos").over(per), 0.0)).withColumn(
        "neg_share", ratio(F.col("n_neg"), F.sum("n_neg").over(per), 0.0))
    gap = F.sum(F.abs(F.col("pos_share") - F.col("neg_share"))).over(per) * 0.5
    return shares.withColumn("tv", F.when(F.sum("n_neg").over(per) > 0, gap).otherwise(1.0))


def typepair_from_examples(examples: DataFrame, keys: list[str]) -> DataFrame:
    return examples.groupBy(*keys, "type_pair").agg(rows().alias("n"), count_if(F.col("connected")).alias("n_connected")).withColumn(
        "p_connected", ratio(F.col("n_connected"), F.col("n"), 0.0))


def sample_per_cell(examples: DataFrame, keys: list[str], k: int, seed: int = C.SEED) -> DataFrame:
    """At most ``k`` examples per cell in a seeded order."""
    hashed = examples.withColumn("_h", hash_order(seed, "example_id"))
    return grouped_row_number(hashed, keys, ["_h", "example_id"], hash_bucket("_h"), "_r").where(F.col("_r") <= k).drop("_h", "_r")


def sample_entries(examples: DataFrame, fraction: float, seed: int = C.SEED) -> DataFrame:
    """All pairs of ``round(fraction * entries)`` entries in a seeded order."""
    entry = examples.select(entry_of_example().alias("entry")).distinct().withColumn("_h", hash_order(seed, "entry")).withColumn("_all", F.lit(1))
    n = entry.agg(F.count(F.lit(1))).scalar()
    chosen = grouped_row_number(entry, ["_all"], ["_h", "entry"], hash_bucket("_h"), "_r").where(F.col("_r") <= F.bround(n * F.lit(float(fraction)), 0))
    return examples.withColumn("entry", entry_of_example()).join(chosen.select("entry"), "entry", "left_semi")


def entry_of_example() -> Column:
    return F.split(F.col("example_id"), "__")[0]


def shared_type_pairs(pairs: DataFrame) -> DataFrame:
    """Type pairs that share a node type ("near"); every other combination is "far"."""
    kinds = pairs.withColumn("kind", F.explode(F.array_distinct(F.split("type_pair", "__"))))
    near = kinds.join(kinds.withColumnRenamed("type_pair", "other"), "kind").where("type_pair <> other").select("type_pair", "other").distinct()
    total = pairs.agg(F.count(F.lit(1))).scalar()
    grouped = near.groupBy("type_pair").agg(rows().alias("n_near"), F.array_join(F.array_sort(F.collect_set("other")), ",").alias("near"))
    return grouped.withColumn("n_far", total - 1 - F.col("n_near"))
