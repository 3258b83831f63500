"""Evaluation aggregates: one pass over the predictions, small tables afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daygraph.functions.columns import count_if, f1, ratio
from daygraph.functions.ranking import bucketed_prefix_sum

# The threshold grid runs from 0.05 to 0.95 in steps of 0.01.
GRID_FIRST, GRID_LAST = 5, 95
GRID_SIZE = GRID_LAST - GRID_FIRST + 1


def label_counts(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """tp, fp, fn per label from ``gold`` and ``pred`` flags (0/1)."""
    g, p = F.col("gold") == 1, F.col("pred") == 1
    return predictions.groupBy(*keys, "concept_id").agg(
        count_if(g & p).alias("tp"), count_if(~g & p).alias("fp"), count_if(g & ~p).alias("fn"))


def multilabel_metrics(counts: DataFrame, keys: list[str], vocabulary: int | Column) -> DataFrame:
    """Micro and macro precision, recall and F1 from label counts.

    Macro means divide by the whole vocabulary, so a label with no row counts as zero.
    """
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    whole = lambda c: F.sum(c)
    macro = lambda value: F.sum(value) / vocabulary
    return counts.groupBy(*keys).agg(
        ratio(whole("tp"), whole("tp") + whole("fp"), 0.0).alias("micro_precision"),
        ratio(whole("tp"), whole("tp") + whole("fn"), 0.0).alias("micro_recall"),
        f1(whole("tp"), whole("fp"), whole("fn")).alias("micro_f1"),
        macro(ratio(tp, tp + fp, 0.0)).alias("macro_precision"), macro(ratio(tp, tp + fn, 0.0)).alias("macro_recall"),
        macro(f1(tp, fp, fn)).alias("macro_f1"))


def binary_metrics(scored: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """Accuracy, precision, recall, F1 and the confusion matrix of ``score`` against ``gold`` (0/1)."""
    g, p = F.col("gold") == 1, F.col("score") >= threshold
    cells = scored.groupBy(*keys).agg(
        count_if(g & p).alias("tp"), count_if(~g & p).alias("fp"), count_if(~g & ~p).alias("tn"), count_if(g & ~p).alias("fn"))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return cells.withColumns({
        "accuracy": ratio(tp + tn, tp + fp + tn + fn, 0.0), "precision": ratio(tp, tp + fp, 0.0), "recall": ratio(tp, tp + fn, 0.0),
        "f1": f1(tp, fp, fn), "n_pos_pred": tp + fp, "n_pos_true": tp + fn, "n_total": tp + fp + tn + fn})


def roc_auc(scored: DataFrame, keys: list[str], buckets: int = 65_536) -> DataFrame:
    """Tie-aware area under the ROC curve; null where a class is missing.

    Equal scores collapse first; negatives below a score come from a prefix sum
    over score buckets, so no window spans all scores.
    """
    by_score = scored.groupBy(*keys, "score").agg(count_if(F.col("gold") == 1).alias("p"), count_if(F.col("gold") == 0).alias("n"))
    keyed = by_score.withColumn("_all", F.lit(1))
    below = bucketed_prefix_sum(keyed, [*keys, "_all"], ["score"], F.floor(F.col("score") * buckets), "n", "below")
    won = F.sum(F.col("p") * (F.col("below") + F.col("n") / 2.0))
    return below.groupBy(*keys).agg(
        F.sum("p").alias("n_pos"), F.sum("n").alias("n_neg"), F.try_divide(won, (F.sum("p") * F.sum("n")).cast("double")).alias("auc"))


def grid_step(score: Column) -> Column:
    """How many grid thresholds a score reaches (0 to 91), compared as ``i / 100.0`` exactly."""
    near = F.floor(score * 100)
    step = F.when((near + 1) / 100.0 <= score, near + 1).when(near / 100.0 <= score, near).otherwise(near - 1)
    return F.least(F.greatest(step - (GRID_FIRST - 1), F.lit(0)), F.lit(GRID_SIZE)).cast("int")


def sweep_curve(scored: DataFrame, keys: list[str]) -> DataFrame:
    """tp, fp, fn at every grid threshold from one histogram of scores."""
    hist = scored.groupBy(*keys, grid_step(F.col("score")).alias("step")).agg(
        count_if(F.col("gold") == 1).alias("p"), count_if(F.col("gold") == 0).alias("n"))
    steps = hist.select(*keys).distinct() if keys else scored.sparkSession.range(1).select()
    dense = steps.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(GRID_SIZE)))).join(hist, [*keys, "step"], "left").fillna(0, ["p", "n"])
    up = Window.partitionBy(*keys).orderBy(F.desc("step"))
    at = dense.withColumn("tp", F.sum("p").over(up)).withColumn("fp", F.sum("n").over(up)).withColumn(
        "n_pos", F.sum("p").over(Window.partitionBy(*keys)))
    return at.where("step > 0").select(
        *keys, ((F.col("step") + (GRID_FIRST - 1)) / 100.0).alias("threshold"), "tp", "fp", (F.col("n_pos") - F.col("tp")).alias("fn"), "n_pos"
    ).withColumn("f1", f1(F.col("tp"), F.col("fp"), F.col("fn")))


def best_threshold(curve: DataFrame, keys: list[str]) -> DataFrame:
    """First threshold of the highest F1."""
    best = curve.groupBy(*keys).agg(F.max(F.struct("f1", (-F.col("threshold")).alias("k"), "n_pos")).alias("m"))
    return best.select(*keys, (-F.col("m.k")).alias("threshold"), F.col("m.f1").alias("dev_f1"), F.col("m.n_pos").alias("n_pos"))


def threshold_per_label(dev: DataFrame, global_threshold: Column) -> DataFrame:
    """Best threshold per label; labels without dev positives use the global one."""
    best = best_threshold(sweep_curve(dev, ["concept_id"]), ["concept_id"])
    return best.select("concept_id", "n_pos", F.when(F.col("n_pos") > 0, F.col("threshold")).otherwise(global_threshold).alias("threshold"))


def ranked_labels(scores: DataFrame) -> DataFrame:
    """Labels per example by score; at most one row per vocabulary entry in a group."""
    order = Window.partitionBy("sample_id").orderBy(F.desc("score"), "concept_id")
    return scores.withColumn("rank", F.row_number().over(order).cast("long"))


def concept_threshold_topk(scores: DataFrame, threshold: float, k: int) -> DataFrame:
    """Labels at or above the threshold, or the top ``k`` where none is."""
    above = F.col("score") >= threshold
    some = F.max(above).over(Window.partitionBy("sample_id"))
    return ranked_labels(scores).withColumn("_some", some).where(above | (~F.col("_some") & (F.col("rank") <= k))).drop("_some")


def label_priors(support: DataFrame, n_examples: Column) -> DataFrame:
    """Prior, log-odds, positive weight and focal alpha per label."""
    p = F.least(F.greatest(F.col("train_support") / n_examples, F.lit(1e-4)), F.lit(1 - 1e-4))
    weight = F.least(F.greatest((n_examples - F.col("train_support")) / F.greatest(F.col("train_support"), F.lit(1)), F.lit(1.0)), F.lit(50.0))
    return support.select("concept_id", "train_support", p.alias("prior"), F.ln(p / (1 - p)).alias("log_odds"),
                          weight.alias("pos_weight"), (1 - p).alias("focal_alpha"))


def first_available(metrics: DataFrame, preference: dict[str, list[str]]) -> DataFrame:
    """For every row name, the metrics of the first run that exists."""
    order = F.create_map(*[F.lit(x) for name, runs in preference.items() for i, run in enumerate(runs) for x in (f"{name}|{run}", i)])
    names = F.create_map(*[x for name, runs in preference.items() for run in runs for x in (F.lit(run), F.lit(name))])
    tagged = metrics.withColumn("name", F.try_element_at(names, F.col("run"))).withColumn(
        "place", F.try_element_at(order, F.concat_ws("|", "name", "run"))).where("name IS NOT NULL")
    return tagged.groupBy("name", "metric").agg(F.min_by(F.struct("run", "value"), "place").alias("m")).select("name", "metric", "m.*")


def run_summary(chosen: DataFrame) -> DataFrame:
    """Full model against the ablations: values, differences and the recoverable share."""
    wide = chosen.groupBy("metric").pivot("name", ["full_model", "pair_only", "type_pol_only"]).agg(F.max("value"))
    return wide.withColumns({
        "delta_pair_only": F.col("full_model") - F.col("pair_only"), "delta_type_pol_only": F.col("full_model") - F.col("type_pol_only"),
        "pct_recoverable": F.when(F.col("full_model") > 0, F.col("pair_only") / F.col("full_model") * 100.0).otherwise(0.0)})
