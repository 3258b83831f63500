"""SQL for the evaluation queries."""

from daygraph.oracle.base import big, r6, sql
from daygraph.oracle.prepare import PREP, hexnum


def scored(seed: int) -> str:
    return f"""SELECT example_id, split, language, type_pair, gold, CAST(CASE WHEN gold = 1 THEN (s + 1000) // 2 ELSE s END AS DOUBLE) / 1000 AS score FROM (
        SELECT example_id, split, language, type_pair, connected::INTEGER AS gold, {hexnum(f"md5('{seed}:' || example_id)", 1, 6)} % 1000 AS s FROM rex)"""


def counts(keys: str, cond: str = "score >= 0.28::DOUBLE") -> str:
    return f"""SELECT {keys} concept_id, count(*) FILTER (gold = 1 AND {cond}) AS tp, count(*) FILTER (gold = 0 AND {cond}) AS fp, count(*) FILTER (gold = 1 AND NOT ({cond})) AS fn"""


def div(a: str, b: str) -> str:
    return f"coalesce(({a})::DOUBLE / nullif({b}, 0), 0.0)"


def metrics(vocab: str) -> str:
    parts = {
        "micro_precision": div("sum(tp)", "sum(tp) + sum(fp)"), "micro_recall": div("sum(tp)", "sum(tp) + sum(fn)"),
        "micro_f1": div("2 * sum(tp)", "2 * sum(tp) + sum(fp) + sum(fn)"), "macro_precision": f"sum({div('tp', 'tp + fp')}) / {vocab}",
        "macro_recall": f"sum({div('tp', 'tp + fn')}) / {vocab}", "macro_f1": f"sum({div('2 * tp', '2 * tp + fp + fn')}) / {vocab}"}
    return ", ".join(f"{r6(v)} AS {k}" for k, v in parts.items())


VOCAB = "(SELECT count(*) FROM concepts)"
EVAL = {
    **PREP,
    "pscore": scored(42),
    "grid": "SELECT i, i / 100.0::DOUBLE AS t FROM range(5, 96) g(i)",
    "lscore": "SELECT l.*, k.split FROM label_scores l JOIN ks k ON k.sample_id = l.sample_id",
    "ranked": "SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, concept_id) AS rank FROM label_scores",
}


def curve(source: str, keys: str) -> str:
    k = keys + ", " if keys else ""
    g = f"GROUP BY {k}t"
    return f"""SELECT {k}t, count(*) FILTER (gold = 1 AND score >= t) AS tp, count(*) FILTER (gold = 0 AND score >= t) AS fp, count(*) FILTER (gold = 1 AND score < t) AS fn,
        {div('2 * count(*) FILTER (gold = 1 AND score >= t)', '2 * count(*) FILTER (gold = 1 AND score >= t) + count(*) FILTER (gold = 0 AND score >= t) + count(*) FILTER (gold = 1 AND score < t)')} AS f1
        FROM ({source}), grid {g}"""


def e(body: str, **extra: str) -> str:
    return sql(body, **EVAL, **extra)


BOTH = "SELECT split, gold, score, 'binary' AS kind FROM pscore UNION ALL SELECT split, gold, score, 'micro' FROM lscore"


def run(seed: int, name: str) -> str:
    cell = lambda c: f"(count(*) FILTER ({c}))"
    tp, fp, fn, tn = cell("gold = 1 AND score >= 0.5"), cell("gold = 0 AND score >= 0.5"), cell("gold = 1 AND score < 0.5"), cell("gold = 0 AND score < 0.5")
    return f"""SELECT '{name}' AS run, unnest(['f1', 'accuracy', 'recall']) AS metric, unnest([{div(f'2 * {tp}', f'2 * {tp} + {fp} + {fn}')}, {div(f'{tp} + {tn}', 'count(*)')}, {div(tp, f'{tp} + {fn}')}]) AS value
        FROM ({scored(seed)}) WHERE split = 'test'"""


PQ = """SELECT sample_id, raw, regexp_extract(raw, '(?s)\\{.*?\\}', 0) AS block FROM (SELECT sample_id, CASE user_id % 7 WHEN 0 THEN good WHEN 1 THEN 'Sure:' || chr(10) || good || chr(10) || 'Done.'
    WHEN 2 THEN '{"present_concepts": ["event_00"' WHEN 3 THEN 'I see none.' WHEN 4 THEN '{"concepts": []}' WHEN 5 THEN '{"present_concepts": "event_00"}' ELSE '{broken} then nothing' END AS raw
    FROM (SELECT *, '{"present_concepts": ["event_00", "thought_01", "made_up_' || day_index || '"]}' AS good FROM samples))"""

ORACLE = {
    "multilabel_metrics": e(f"SELECT {metrics(VOCAB)}, (SELECT count(*) FROM samples) AS n_examples FROM ({counts('')} FROM label_scores GROUP BY concept_id)"),
    "multilabel_metrics_common": e(f"""SELECT {metrics('(SELECT count(*) FROM idx WHERE train_support >= 60)')}, (SELECT count(*) FROM idx WHERE train_support >= 60) AS n_labels
        FROM ({counts('')} FROM label_scores WHERE concept_id IN (SELECT concept_id FROM idx WHERE train_support >= 60) GROUP BY concept_id)"""),
    "metrics_by_language": e(f"""SELECT language, {metrics(VOCAB)} FROM ({counts('language,')} FROM label_scores GROUP BY language, concept_id UNION ALL {counts("'all' AS language,")} FROM label_scores GROUP BY concept_id) GROUP BY language"""),
    "binary_metrics": e(f"""SELECT split, tp, fp, tn, fn, {r6(div('tp + tn', 'tp + fp + tn + fn'))} AS accuracy, {r6(div('tp', 'tp + fp'))} AS precision, {r6(div('tp', 'tp + fn'))} AS recall,
        {r6(div('2 * tp', '2 * tp + fp + fn'))} AS f1, tp + fp AS n_pos_pred, tp + fn AS n_pos_true, tp + fp + tn + fn AS n_total FROM (SELECT split, {big('count(*) FILTER (gold = 1 AND score >= 0.39::DOUBLE)')} AS tp,
        {big('count(*) FILTER (gold = 0 AND score >= 0.39::DOUBLE)')} AS fp, {big('count(*) FILTER (gold = 0 AND score < 0.39::DOUBLE)')} AS tn, {big('count(*) FILTER (gold = 1 AND score < 0.39::DOUBLE)')} AS fn FROM pscore GROUP BY 1)"""),
    "roc_auc": e(f"""SELECT split, {big('sum(gold)')} AS n_pos, {big('sum(1 - gold)')} AS n_neg, {r6('(sum(r) FILTER (gold = 1) - sum(gold) * (sum(gold) + 1) / 2.0) / nullif(sum(gold) * sum(1 - gold), 0)')} AS auc FROM (
        SELECT *, rank() OVER (PARTITION BY split ORDER BY score) + (count(*) OVER (PARTITION BY split, score) - 1) / 2.0::DOUBLE AS r FROM (
        SELECT split, gold, score FROM pscore UNION ALL SELECT 'positives only', gold, score FROM pscore WHERE gold = 1)) GROUP BY 1"""),
    "threshold_sweep": e(f"""SELECT b.kind, {r6('b.t')} AS threshold, {r6('b.f1')} AS dev_f1, b.n_pos, {r6('c.f1')} AS test_f1, c.tp AS test_tp FROM (
        SELECT *, tp + fn AS n_pos, row_number() OVER (PARTITION BY kind ORDER BY f1 DESC, t) AS r FROM dev_curve) b LEFT JOIN test_curve c ON c.kind = b.kind AND c.t = b.t WHERE b.r = 1""",
        both_kinds=BOTH, dev_curve=curve("SELECT * FROM both_kinds WHERE split = 'dev'", "kind"), test_curve=curve("SELECT * FROM both_kinds WHERE split = 'test'", "kind")),
    "threshold_per_label": e(f"""SELECT concept_id, n_pos, {r6("CASE WHEN n_pos > 0 THEN t ELSE (SELECT t FROM whole ORDER BY f1 DESC, t LIMIT 1) END")} AS threshold FROM (
        SELECT *, tp + fn AS n_pos, row_number() OVER (PARTITION BY concept_id ORDER BY f1 DESC, t) AS r FROM each) WHERE r = 1""",
        dev="SELECT concept_id, CASE WHEN concept_id LIKE '%_02' THEN 0 ELSE gold END AS gold, score FROM lscore WHERE split = 'dev'", each=curve("SELECT * FROM dev", "concept_id"), whole=curve("SELECT * FROM dev", "")),
    "top15_predictions": e("""SELECT sample_id, coalesce(string_agg(concept_id, ',' ORDER BY concept_id) FILTER (gold = 1), '') AS gold, coalesce(string_agg(concept_id, ',' ORDER BY concept_id) FILTER (score >= 0.28::DOUBLE), '') AS pred,
        string_agg(concept_id || '=' || CAST(round(score * 1000) AS INTEGER), ',' ORDER BY rank) FILTER (rank <= 15) AS top15 FROM ranked GROUP BY 1"""),
    "concept_threshold_topk": e("""SELECT sample_id, concept_id, score, rank FROM (SELECT *, max(score) OVER (PARTITION BY sample_id) AS m FROM ranked) WHERE score >= 0.97::DOUBLE OR (m < 0.97::DOUBLE AND rank <= 3)"""),
    "predicted_top10": e(f"""SELECT sample_id, string_agg(replace(concept_id, '_', ' '), ', ' ORDER BY rank) FILTER (rank <= 10) AS shown, {big('greatest(count(*) - 10, 0)')} AS more FROM (
        SELECT *, max(score) OVER (PARTITION BY sample_id) AS m FROM ranked) WHERE score >= 0.6::DOUBLE OR (m < 0.6::DOUBLE AND rank <= 3) GROUP BY 1"""),
    "label_priors": e(f"""SELECT concept_id, train_support, {r6('p')} AS prior, {r6('ln(p / (1 - p))')} AS log_odds, {r6('least(greatest((n - train_support)::DOUBLE / greatest(train_support, 1), 1.0), 50.0)')} AS pos_weight,
        {r6('1 - p')} AS focal_alpha FROM (SELECT concept_id, train_support, n, least(greatest(train_support::DOUBLE / n, 1e-4::DOUBLE), 1 - 1e-4::DOUBLE) AS p FROM idx, (SELECT count(*) AS n FROM ks WHERE split = 'train'))"""),
    "parse_quality": e(f"""SELECT outcome, count(DISTINCT sample_id) AS answers, {big('count(*) FILTER (concept_id IS NOT NULL AND concept_id IN (SELECT concept_id FROM concepts))')} AS in_vocabulary,
        {big('count(*) FILTER (concept_id IS NOT NULL AND concept_id NOT IN (SELECT concept_id FROM concepts))')} AS invalid FROM (
        SELECT sample_id, outcome, unnest(CASE WHEN outcome = 'ok' THEN list_distinct(CAST(json_extract(v, '$.present_concepts') AS VARCHAR[])) ELSE [NULL] END) AS concept_id FROM (
        SELECT sample_id, v, CASE WHEN v IS NULL AND block = '' THEN 'no_json_object_found' WHEN v IS NULL THEN 'could_not_parse' WHEN json_extract(v, '$.present_concepts') IS NULL THEN 'missing_key_present_concepts'
        WHEN json_type(v, '$.present_concepts') <> 'ARRAY' THEN 'present_concepts_not_list' ELSE 'ok' END AS outcome FROM (
        SELECT *, CASE WHEN json_valid(trim(raw)) THEN trim(raw) WHEN block <> '' AND json_valid(block) THEN block END AS v FROM pq))) GROUP BY 1""", pq=PQ),
    "run_summary_table": e(f"""SELECT metric, {r6('f')} AS full_model, {r6('p')} AS pair_only, {r6('t')} AS type_pol_only, {r6('f - p')} AS delta_pair_only, {r6('f - t')} AS delta_type_pol_only, {r6('p / f * 100.0')} AS pct_recoverable FROM (
        SELECT metric, max(value) FILTER (run = 'full_v2') AS f, max(value) FILTER (run = 'pair_only') AS p, max(value) FILTER (run = 'type_pol_only') AS t FROM runs GROUP BY 1)""",
        runs=" UNION ALL ".join(run(s, n) for s, n in [(1, "full_v2"), (2, "pair_only"), (3, "type_pol_only")])),
    "seed_variance": e(f"SELECT run AS arm, metric, {r6('avg(value)')} AS mean, {r6('min(value)')} AS low, {r6('max(value)')} AS high, count(*) AS seeds FROM runs GROUP BY 1, 2",
        runs=" UNION ALL ".join(run(s, n) for n, b in (("text", 42), ("no text", 142)) for s in range(b, b + 3))),
    "over_length_share": e(f"""SELECT split, count(*) AS texts, {big('count(*) FILTER (n > 256)')} AS over, {r6('count(*) FILTER (n > 256)::DOUBLE / count(*)')} AS share FROM (
        SELECT k.split, len(list_filter(string_split_regex(t.text, '\\s+'), lambda x: x <> '')) AS n FROM texts t JOIN ks k ON k.sample_id = t.sample_id) GROUP BY 1"""),
}
