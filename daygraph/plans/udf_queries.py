"""Registered queries on user-supplied functions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from daygraph.functions.columns import r6, rows
from daygraph.operators import evaluate as E
from daygraph.operators import udfs as U
from daygraph.plans.prepare_queries import kept_samples
from daygraph.plans.text_queries import example_pairs
from daygraph.sources.day_graphs import DayGraphs


def udf_scorer(spark, sf_dir):
    """A scorer of whole batches: here one that SQL can repeat, from the length of the text and the number of the concept."""
    t = DayGraphs(spark, sf_dir)
    concepts = sorted(r.concept_id for r in t.concepts().select("concept_id").collect())  # the closed vocabulary

    def score(texts: pa.Array) -> np.ndarray:
        number = np.arange(len(concepts))
        size = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        return (size[:, None] * (7919 + 13 * number) + 104729 * number) % 1000 / 1000.0

    return U.score_texts(t.texts(), score, concepts)


def udf_feature_fn(spark, sf_dir):
    def features(a: pa.Array, b: pa.Array, polarity_a: pa.Array, polarity_b: pa.Array) -> list:
        named = lambda name, values: pc.binary_join_element_wise(name, values, "=")
        same = pc.if_else(pc.equal(polarity_a, polarity_b), "same=True", "same=False")
        return [(named("type_a", a), 1.0), (named("type_b", b), 1.0), (same, 0.5)]

    pairs = example_pairs(DayGraphs(spark, sf_dir))
    made = pairs.select("example_id", U.feature_udf(features)("type_a", "type_b", "polarity_a", "polarity_b").alias("m"))
    return made.select("example_id", F.explode("m").alias("feature", "value"))


def udaf_select_fn(spark, sf_dir):
    def first_best(threshold, value):
        order = threshold.sort_values(kind="stable").index
        return threshold[value[order].idxmax()]

    t = DayGraphs(spark, sf_dir)
    dev = t.label_scores().join(kept_samples(t).where("split = 'dev'").select("sample_id"), "sample_id", "left_semi")
    curve = E.sweep_curve(dev, ["concept_id"])
    return curve.groupBy("concept_id").agg(U.select_udaf(first_best)("threshold", "f1").alias("threshold")).withColumn("threshold", r6(F.col("threshold")))


def udtf_pairs(spark, sf_dir):
    counts = DayGraphs(spark, sf_dir).nodes().groupBy("sample_id", "type").agg(rows().alias("n")).groupBy("sample_id").agg(
        F.collect_list(F.struct("type", "n")).alias("counts"))
    spark.udtf.register("type_pairs_of", U.pair_udtf())
    return spark.sql("SELECT sample_id, p.* FROM {c}, LATERAL type_pairs_of(counts) p", c=counts)


QUERIES = {f.__name__: f for f in [udf_scorer, udf_feature_fn, udaf_select_fn, udtf_pairs]}
