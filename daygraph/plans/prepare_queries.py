"""Registered queries on dataset preparation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from daygraph.functions.columns import count_if, r6, ratio, rows
from daygraph.operators import prepare as P
from daygraph.plans.verify_queries import records
from daygraph.sources.day_graphs import DayGraphs


def kept(t):
    return records(t).where("decision = 'accept'")


def splits(t):
    return t.stored("splits", lambda: P.stratified_split(kept(t).select("participant_id", "language").distinct()))


def kept_samples(t):
    return P.assign_split(kept(t), splits(t))


def kept_graphs(t):
    """Nodes with split, and edges, of the kept samples."""
    s = kept_samples(t).select("sample_id", "split")
    nodes = t.stored("kept_nodes", lambda: t.nodes().join(s, "sample_id"))
    return nodes, t.stored("kept_edges", lambda: t.edges().join(s.select("sample_id"), "sample_id", "left_semi"))


def labels(t):
    return P.sample_labels(t.nodes()).join(kept_samples(t).select("sample_id", "participant_id", "language", "split"), "sample_id")


def index(t):
    return t.stored("label_index", lambda: P.label_index(labels(t).where("split = 'train'").select("sample_id", "concept_id")))


def kept_positives(t):
    """Connected pairs of the kept graphs; random and hard negatives and their plans read them."""
    return t.stored("kept_positives", lambda: P.positives(*kept_graphs(t)))


def random_examples(t):
    def build():
        nodes, edges = kept_graphs(t)
        pos = kept_positives(t)
        both = P.union_pos_neg(pos, P.negatives_random(nodes, edges, pos=pos))
        return both.join(kept_samples(t).select("sample_id", "language", "split"), "sample_id")
    return t.stored("random_examples", build)


def hard_tables(t):
    nodes, edges = kept_graphs(t)
    plan = t.stored("hard_plan", lambda: P.hard_plan(nodes, edges, pos=kept_positives(t)))
    return plan, t.stored("hard_negatives", lambda: P.negatives_hard(nodes, edges, plan, pos=kept_positives(t)))


def stratified_split(spark, sf_dir):
    return splits(DayGraphs(spark, sf_dir))


def assign_split(spark, sf_dir):
    return kept_samples(DayGraphs(spark, sf_dir)).select("sample_id", "participant_id", "split")


def node_examples(spark, sf_dir):
    t = DayGraphs(spark, sf_dir)
    return P.node_examples(kept(t), t.nodes(), t.with_texts).select(
        F.col("sample_id").alias("example_id"), "participant_id", "day_index", "language", "text",
        F.array_join("labels", ",").alias("labels"), F.array_join("label_surface", ",").alias("label_surface"), "num_nodes")


def label_index(spark, sf_dir):
    return index(DayGraphs(spark, sf_dir))


def rare_labels(spark, sf_dir):
    return index(DayGraphs(spark, sf_dir)).orderBy("train_support", "concept_id").limit(15).select("concept_id", "train_support")


def unseen_labels(spark, sf_dir):
    """Fine-grained labels that train has never seen, per split: examples and labels."""
    t = DayGraphs(spark, sf_dir)
    fine = t.nodes().select("sample_id", F.concat_ws("_", "concept_id", (F.col("event_id") % 977).cast("string")).alias("concept_id")).distinct()
    mine = fine.join(kept_samples(t).select("sample_id", "split"), "sample_id")
    known = P.label_index(mine.where("split = 'train'").select("sample_id", "concept_id"))
    missing = P.unseen_labels(mine, known)
    return missing.groupBy("split").agg(F.countDistinct("sample_id").alias("examples"), rows().alias("labels"))


def split_report(spark, sf_dir):
    t = DayGraphs(spark, sf_dir)
    s = kept_samples(t)
    people = splits(t).groupBy("split").agg(rows().alias("participants"), *[count_if(F.col("language") == g).alias(f"participants_{g}") for g in ("en", "de")])
    examples = s.groupBy("split").agg(rows().alias("examples"), *[count_if(F.col("language") == g).alias(f"examples_{g}") for g in ("en", "de")],
                                      r6(ratio(count_if(F.col("language") == "en"), rows(), 0.0)).alias("en_share"))
    pairs = random_examples(t).groupBy("split").agg(count_if(F.col("connected")).alias("positives"), count_if(~F.col("connected")).alias("negatives"))
    return people.join(examples, "split", "left").join(pairs, "split", "left")


def split_checks(spark, sf_dir):
    t = DayGraphs(spark, sf_dir)
    return P.split_checks(splits(t), kept_samples(t), index(t)).withColumn("value", r6(F.col("value")))


def split_intersections(spark, sf_dir):
    """Participants found in two splits, one row per pair of splits."""
    s = kept_samples(DayGraphs(spark, sf_dir)).select("participant_id", "split")
    of = lambda name: s.where(F.col("split") == name).select("participant_id")
    out = None
    for a, b in (("train", "dev"), ("train", "test"), ("dev", "test")):
        row = of(a).intersect(of(b)).agg(rows().alias("shared")).select(F.lit(f"{a}&{b}").alias("splits"), "shared")
        out = row if out is None else out.unionByName(row)
    return out


def pool_minus_vocab(spark, sf_dir):
    """Pool concepts outside a reduced label index, and labels outside the pool."""
    t = DayGraphs(spark, sf_dir)
    pool = t.concepts().select("concept_id")
    vocab = labels(t).where("split = 'train' AND concept_id NOT LIKE '%_02'").select("concept_id").distinct()
    return pool.exceptAll(vocab).withColumn("side", F.lit("pool only")).unionByName(vocab.exceptAll(pool).withColumn("side", F.lit("label only")))


def edge_examples_project(spark, sf_dir):
    """Examples with both node payloads; the text stays in its own table."""
    t = DayGraphs(spark, sf_dir)
    payload = F.to_json(F.struct("node_id", "concept_id", "label", "type", "polarity", "anchor", "day_offset"))
    nodes = t.nodes().select("sample_id", "node_id", payload.alias("p"))
    n_edges = t.edges().groupBy("sample_id").agg(rows().alias("graph_num_edges"))
    return (
        random_examples(t).select("example_id", "sample_id", "node_a", "node_b", "connected")
        .join(nodes.select("sample_id", F.col("node_id").alias("node_a"), F.col("p").alias("payload_a")), ["sample_id", "node_a"])
        .join(nodes.select("sample_id", F.col("node_id").alias("node_b"), F.col("p").alias("payload_b")), ["sample_id", "node_b"])
        .join(t.samples().select("sample_id", F.col("n_nodes").alias("graph_num_nodes")), "sample_id").join(n_edges, "sample_id", "left")
        .select("example_id", "payload_a", "payload_b", "connected", "graph_num_nodes", "graph_num_edges")
    )


def entry_of_example(spark, sf_dir):
    return random_examples(DayGraphs(spark, sf_dir)).select("example_id", P.entry_of_example().alias("entry"))


def negatives_random(spark, sf_dir):
    return random_examples(DayGraphs(spark, sf_dir)).where("NOT connected").select("sample_id", "node_a", "node_b", "type_pair")


def union_pos_neg(spark, sf_dir):
    return random_examples(DayGraphs(spark, sf_dir)).select("example_id", "split", "language", "type_pair", "connected")


def connected_fraction(spark, sf_dir):
    return random_examples(DayGraphs(spark, sf_dir)).groupBy("split").agg(rows().alias("n"), r6(F.avg(F.col("connected").cast("int"))).alias("connected_fraction"))


def typepair_from_examples(spark, sf_dir):
    out = P.typepair_from_examples(random_examples(DayGraphs(spark, sf_dir)).where("split = 'train'"), [])
    return out.withColumn("p_connected", r6(F.col("p_connected"))).withColumn(
        "rank", F.row_number().over(Window.orderBy(F.desc("n"), "type_pair")).cast("long"))


def largest_remainder(spark, sf_dir):
    """Targets at a ratio of 0.7, where the remainders matter."""
    pos = random_examples(DayGraphs(spark, sf_dir)).where("connected").groupBy("split", "type_pair").agg(rows().alias("n_pos"))
    return P.largest_remainder(pos, ["split"], 0.7)


def negatives_hard(spark, sf_dir):
    return hard_tables(DayGraphs(spark, sf_dir))[1].select("split", "sample_id", "node_a", "node_b", "type_pair")


def negatives_hard_report(spark, sf_dir):
    plan, negatives = hard_tables(DayGraphs(spark, sf_dir))
    got = negatives.groupBy("split", "type_pair").agg(rows().alias("achieved"))
    return plan.join(got, ["split", "type_pair"], "left").withColumn("achieved", F.coalesce("achieved", F.lit(0)).cast("long"))


def tv_distance(spark, sf_dir):
    report = negatives_hard_report(spark, sf_dir).select("split", "type_pair", "n_pos", F.col("achieved").alias("n_neg"))
    out = P.tv_distance(report, ["split"])
    return out.withColumns({c: r6(F.col(c)) for c in ("pos_share", "neg_share", "tv")})


def sample_per_cell(spark, sf_dir):
    return P.sample_per_cell(random_examples(DayGraphs(spark, sf_dir)), ["language", "connected"], 500).select("example_id", "language", "connected")


def sample_entries_fraction(spark, sf_dir):
    train = random_examples(DayGraphs(spark, sf_dir)).where("split = 'train'")
    return P.sample_entries(train, 0.3).groupBy("entry").agg(rows().alias("pairs"))


def sample_by_entry(spark, sf_dir):
    """All pairs of the entries with five or more nodes."""
    t = DayGraphs(spark, sf_dir)
    big = t.samples().where("n_nodes >= 5").select("sample_id")
    return random_examples(t).join(big, "sample_id", "left_semi").select("example_id", "connected")


def shared_type_pairs(spark, sf_dir):
    return P.shared_type_pairs(random_examples(DayGraphs(spark, sf_dir)).select("type_pair").distinct())


def head_subset(spark, sf_dir):
    order = Window.partitionBy("split").orderBy("sample_id")
    return kept_samples(DayGraphs(spark, sf_dir)).select("split", "sample_id", F.row_number().over(order).cast("long").alias("n")).where("n <= 100")


QUERIES = {f.__name__: f for f in [
    stratified_split, assign_split, node_examples, label_index, rare_labels, unseen_labels, split_report, split_checks,
    split_intersections, pool_minus_vocab, edge_examples_project, entry_of_example, negatives_random, union_pos_neg,
    connected_fraction, typepair_from_examples, largest_remainder, negatives_hard, negatives_hard_report, tv_distance,
    sample_per_cell, sample_entries_fraction, sample_by_entry, shared_type_pairs, head_subset,
]}
