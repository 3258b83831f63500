"""User-supplied functions on Arrow batches: scorer, features, threshold choice, generator."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def score_texts(texts: DataFrame, scorer: Callable[[pa.Array], np.ndarray], labels: list[str]) -> DataFrame:
    """``sample_id, concept_id, score`` of every label, from a scorer of whole Arrow batches.

    The scorer takes the texts of a batch and gives a matrix, a row per text and a column per
    label; rows are spread out by Spark, not in Python.
    """
    def run(column: pa.Array) -> pa.Array:
        scores = np.asarray(scorer(column), dtype=np.float64).reshape(len(column), len(labels))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(column) + 1) * len(labels), pa.int32()), pa.array(scores.ravel()))

    made = texts.select("sample_id", F.arrow_udf(run, "array<double>")("text").alias("scores"))
    names = F.array(*[F.lit(c) for c in labels])
    return made.select("sample_id", F.posexplode("scores").alias("at", "score")).select("sample_id", F.get(names, F.col("at")).alias("concept_id"), "score")


def feature_udf(feature_fn: Callable[..., list[tuple[pa.Array, float]]]):
    """A feature function of whole columns as an Arrow UDF that returns a map per row.

    The function gives one pair per feature: the names of a batch, and their value.
    """
    def run(*columns: pa.Array) -> pa.Array:
        found = feature_fn(*columns)
        n, k = len(columns[0]), len(found)
        order = np.arange(n * k).reshape(k, n).T.ravel()  # by row instead of by feature
        names = pa.concat_arrays([x.cast(pa.string()) for x, _ in found]).take(pa.array(order))
        return pa.MapArray.from_arrays(pa.array(np.arange(n + 1) * k, pa.int32()), names, pa.array(np.tile([v for _, v in found], n)))

    return F.arrow_udf(run, "map<string,double>")


def select_udaf(select_fn: Callable[[pd.Series, pd.Series], float]):
    """A choice over a (bounded) curve as a grouped aggregate."""
    def run(threshold: pd.Series, value: pd.Series) -> float:
        return float(select_fn(threshold, value))

    return F.pandas_udf(run, "double")


def pair_udtf():
    """Generator from the type counts of one graph to its type-pair counts."""
    class TypePairs:
        def eval(self, counts):
            items = sorted((c["type"], c["n"]) for c in counts)
            for i, (a, n) in enumerate(items):
                for b, m in items[i:]:
                    total = n * (n - 1) // 2 if a == b else n * m
                    if total:
                        yield a, b, total

    return F.udtf(TypePairs, returnType="type_a string, type_b string, n_pairs long")
