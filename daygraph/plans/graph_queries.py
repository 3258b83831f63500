"""Registered queries on graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from daygraph import constants as C
from daygraph.functions.columns import r6
from daygraph.operators import graph as G
from daygraph.sources.day_graphs import DayGraphs


def both(spark, sf_dir):
    tables = DayGraphs(spark, sf_dir)
    return tables.nodes(), tables.edges()


def graph_pairs(spark, sf_dir):
    return G.pair_counts(DayGraphs(spark, sf_dir).nodes())


def edge_endpoints(spark, sf_dir):
    return G.edge_endpoints(*both(spark, sf_dir)).select(
        "sample_id", "edge_id", "source_node_id", "target_node_id", "source_concept_id", "target_concept_id", "edge_type", "weight"
    )


def pair_connected(spark, sf_dir):
    return G.connected_pairs(*both(spark, sf_dir)).select(
        "sample_id", F.col("node_id_a").alias("node_a"), F.col("node_id_b").alias("node_b"), "type_a", "type_b", "n_edges",
        F.lit(True).alias("connected"),
    )


def negative_candidates(spark, sf_dir):
    return G.pair_balance(*both(spark, sf_dir)).where("n_candidates > 0")


def typepair_connectivity(spark, sf_dir):
    return G.typepair_connectivity(*both(spark, sf_dir)).withColumn("p", r6(F.col("p")))


def band_flag(spark, sf_dir):
    stats = G.typepair_connectivity(*both(spark, sf_dir))
    n = DayGraphs(spark, sf_dir).samples().agg(F.count(F.lit(1))).scalar()
    strict = G.band_flag(stats, C.BAND_MIN_COUNT).withColumnRenamed("flag", "strict_flag")
    closed = G.band_flag(strict, C.BAND_MIN_COUNT, strict=False).withColumnRenamed("flag", "closed_flag")
    run_min = F.when(n < C.SMALL_RUN_GRAPHS, C.SMALL_RUN_MIN).otherwise(C.LARGE_RUN_MIN)
    low, high = C.BAND
    return closed.withColumn(
        "run_flag", F.when(F.col("cooccur") < run_min, "").when((F.col("p") > low) & (F.col("p") < high), "ok").otherwise("OUT")
    ).withColumn("p", r6(F.col("p")))


def unresolved_nodes(spark, sf_dir):
    return G.unresolved_nodes(DayGraphs(spark, sf_dir).nodes()).select(
        "sample_id", "node_id", "concept_id", "type", "label", "polarity", "anchor"
    )


def verbalise_edges(spark, sf_dir):
    return G.verbalise_edges(*both(spark, sf_dir))


def compat_relation(spark, sf_dir):
    return G.compat_relation(*both(spark, sf_dir))


def relation_majority(spark, sf_dir):
    return G.relation_majority(*both(spark, sf_dir))


def relation_pick(spark, sf_dir):
    nodes, edges = both(spark, sf_dir)
    ends = G.edge_endpoints(nodes, edges)
    pairs = ends.select(
        F.explode(F.array(
            F.struct(F.col("source_type").alias("type_a"), F.col("target_type").alias("type_b")),
            F.struct(F.col("target_type").alias("type_a"), F.col("source_type").alias("type_b")),
        )).alias("p")
    ).select("p.*").distinct()
    return G.relation_pick(pairs, G.relation_majority(nodes, edges))


def concept_lookup(spark, sf_dir):
    tables = DayGraphs(spark, sf_dir)
    ids = tables.nodes().select(
        "sample_id", "node_id",
        F.when(F.col("event_id") % 83 == 0, F.concat(F.lit("other_"), F.col("k").cast("string"))).otherwise(F.col("concept_id")).alias("concept_id"),
    )
    return G.concept_lookup(ids, tables.concepts())


def day_polarity(spark, sf_dir):
    return G.day_polarity(DayGraphs(spark, sf_dir).nodes())


def node_degree(spark, sf_dir):
    return G.node_degree(*both(spark, sf_dir))


def droppable_edges(spark, sf_dir):
    return G.droppable_edges(DayGraphs(spark, sf_dir).edges())


QUERIES = {f.__name__: f for f in [
    graph_pairs, edge_endpoints, pair_connected, negative_candidates, typepair_connectivity, band_flag,
    unresolved_nodes, verbalise_edges, compat_relation, relation_majority, relation_pick, concept_lookup,
    day_polarity, node_degree, droppable_edges,
]}
