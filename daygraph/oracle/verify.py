"""SQL for the verification queries."""

from daygraph import constants as C
from daygraph.oracle.base import big, r6, sql
from daygraph.oracle.graph import PAIRS

W = "\\p{L}\\p{N}_"


def snip(pos: str, n: int) -> str:
    return f"trim(replace(substr(text, greatest({pos} - 25, 1), {pos} + {n} + 25 - greatest({pos} - 25, 1)), chr(10), ' '))"


def _time_rows() -> str:
    parts = []
    def add(lang, cond, kind, phrase, pos, order):
        safe = phrase.replace("'", "''")
        parts.append(f"""SELECT sample_id, {order} AS ord, 'extra {kind} reference ''{safe}'' not in graph' AS content, {snip(pos, len(phrase))} AS evidence
            FROM timed WHERE language {'=' if lang == 'de' else '<>'} 'de' AND {cond}""")
    order = 100
    at = lambda p: f"instr(low, '{p}')"
    add("en", f"{at('tomorrow')} > 0 AND {at('the day after tomorrow')} = 0 AND NOT future", "future", "tomorrow", at("tomorrow"), order)
    for p in C.PAST_EN:
        order += 1
        add("en", f"{at(p)} > 0 AND NOT past", "past", p, at(p), order)
    for p in C.EXTRA_TIME_EN:
        order += 1
        add("en", f"{at(p)} > 0", "time", p, at(p), order)
    add("de", "morgen_at > 0 AND NOT future", "future", "morgen", "morgen_at", 100)
    order = 100
    for p in C.PAST_DE:
        order += 1
        add("de", f"{at(p)} > 0 AND NOT past", "past", p, at(p), order)
    for p in C.EXTRA_TIME_DE:
        order += 1
        add("de", f"{at(p)} > 0", "time", p, at(p), order)
    return " UNION ALL ".join(parts)


NODE_JSON = "concat_ws('|', pos, node_id, concept_id, type, label, polarity, anchor, day_offset, temporal_status, confidence)"
EDGE_JSON = "concat_ws('|', edge_no, edge_id, source_node_id, target_node_id, edge_type, weight)"


def scores_sql(extra: str) -> str:
    return f"""SELECT * REPLACE (round_even(node_coverage, 4) AS node_coverage, round_even(edge_coverage, 4) AS edge_coverage, round_even(temporal_consistency, 4) AS temporal_consistency),
        CASE WHEN parsed THEN round_even(0.40::DOUBLE * node_coverage + 0.25::DOUBLE * edge_coverage + 0.25::DOUBLE * temporal_consistency
        + 0.10::DOUBLE * (1.0::DOUBLE - hallucination_score), 4) ELSE 0.0::DOUBLE END AS overall_confidence FROM (
      SELECT *, CASE WHEN NOT parsed THEN 0.0 WHEN nodes_total = 0 THEN 1.0 ELSE nodes_mentioned::DOUBLE / nodes_total END AS node_coverage,
        CASE WHEN NOT parsed THEN 0.0 WHEN edges_total = 0 THEN 1.0 ELSE edges_expressed::DOUBLE / edges_total END AS edge_coverage,
        CASE WHEN NOT parsed THEN 0.0 WHEN nodes_total = 0 THEN 1.0 ELSE nodes_timed::DOUBLE / nodes_total END AS temporal_consistency,
        CASE WHEN parsed THEN round_even(least(hallucination_count, 3)::DOUBLE / 3, 4) ELSE 1.0 END AS hallucination_score FROM (
        SELECT s.sample_id, s.language, s.scenario, s.parsed, coalesce(n.n, 0) AS nodes_total, coalesce(e.n, 0) AS edges_total,
          CASE WHEN parsed THEN coalesce(n.m, 0) ELSE 0 END AS nodes_mentioned, CASE WHEN parsed THEN coalesce(n.t, 0) ELSE 0 END AS nodes_timed,
          CASE WHEN parsed THEN coalesce(e.x, 0) ELSE 0 END AS edges_expressed, CASE WHEN parsed THEN coalesce(n.bad, 0) ELSE 0 END AS bad_nodes,
          CASE WHEN parsed THEN coalesce(e.bad, 0) ELSE 0 END AS bad_edges,
          CASE WHEN parsed THEN CAST(coalesce({extra}, 0) AS BIGINT) ELSE 0 END AS hallucination_count
        FROM samples s LEFT JOIN (SELECT sample_id, count(*) AS n, CAST(count(*) FILTER (mentioned) AS BIGINT) AS m, CAST(count(*) FILTER (temporal_correct) AS BIGINT) AS t,
            CAST(count(*) FILTER (n_verdicts <> 1) AS BIGINT) AS bad FROM jn GROUP BY 1) n ON n.sample_id = s.sample_id
        LEFT JOIN (SELECT sample_id, count(*) AS n, CAST(count(*) FILTER (expressed) AS BIGINT) AS x, CAST(count(*) FILTER (n_verdicts <> 1) AS BIGINT) AS bad FROM je GROUP BY 1) e
          ON e.sample_id = s.sample_id
        LEFT JOIN (SELECT sample_id, count(*) AS n FROM merged GROUP BY 1) m ON m.sample_id = s.sample_id))"""


DECIDE = """CASE WHEN NOT parsed OR bad_nodes + bad_edges > 0 THEN 'reject'
    WHEN node_coverage >= 1.0 AND edge_coverage >= 0.9::DOUBLE AND temporal_consistency >= 0.95::DOUBLE AND hallucination_count <= 0 THEN 'accept'
    WHEN node_coverage >= 0.75::DOUBLE AND edge_coverage >= 0.6::DOUBLE AND temporal_consistency >= 0.75::DOUBLE AND hallucination_count <= 1 THEN 'review' ELSE 'reject' END"""

VERIFY = {
    **PAIRS,
    "nv": "SELECT sample_id, node_id, arg_max(coalesce(mentioned, FALSE), ord) AS mentioned, arg_max(temporal_correct, ord) AS temporal_correct, count(*) AS n_verdicts FROM node_verdicts GROUP BY 1, 2",
    "evd": "SELECT sample_id, edge_id, arg_max(expressed, ord) AS expressed, count(*) AS n_verdicts FROM edge_verdicts GROUP BY 1, 2",
    "jn": """SELECT n.*, coalesce(v.mentioned, FALSE) AS mentioned, coalesce(v.temporal_correct, FALSE) AS temporal_correct, coalesce(v.n_verdicts, 0) AS n_verdicts
        FROM nodes n LEFT JOIN nv v ON v.sample_id = n.sample_id AND v.node_id = n.node_id""",
    "je": """SELECT e.*, coalesce(v.expressed, FALSE) AS expressed, coalesce(v.n_verdicts, 0) AS n_verdicts
        FROM edges e LEFT JOIN evd v ON v.sample_id = e.sample_id AND v.edge_id = e.edge_id""",
    "timed": f"""SELECT t.sample_id, t.language, t.text, lower(t.text) AS low, o.future, o.past,
        CASE WHEN regexp_matches(masked, '^morgen([^{W}]|$)') THEN 1
             WHEN regexp_matches(masked, '[^{W}]morgen([^{W}]|$)') THEN length(regexp_extract(masked, '(?s)^(.*?[^{W}])morgen([^{W}]|$)', 1)) + 1 ELSE 0 END AS morgen_at
        FROM (SELECT *, regexp_replace(text, '(?i)heute morgen', 'heute xxxxxx', 'g') AS masked FROM texts) t
        JOIN (SELECT sample_id, bool_or(day_offset = 1) AS future, bool_or(day_offset = -1) AS past FROM nodes GROUP BY 1) o ON o.sample_id = t.sample_id""",
    "time_rows": _time_rows(),
    "kept": "SELECT sample_id, ord, trim(content) AS content, trim(evidence) AS evidence FROM extras WHERE trim(content) <> ''",
    "merged": """SELECT * FROM kept UNION ALL SELECT * FROM time_rows t WHERE
        NOT EXISTS (SELECT 1 FROM kept k WHERE k.sample_id = t.sample_id AND (contains(lower(k.content), lower(t.content)) OR contains(lower(t.content), lower(k.content))))
        AND NOT EXISTS (SELECT 1 FROM time_rows k WHERE k.sample_id = t.sample_id AND k.ord < t.ord AND (contains(lower(k.content), lower(t.content)) OR contains(lower(t.content), lower(k.content))))""",
    "full_scores": scores_sql("m.n"),
    "stored": f"SELECT *, {DECIDE} AS decision FROM full_scores",
    "recs": "SELECT s.*, d.decision FROM samples s JOIN stored d ON d.sample_id = s.sample_id",
    "hashes": """SELECT sample_id, sha1(concat_ws(':', coalesce(n, 0), coalesce(nh, 0), coalesce(nl, 0), coalesce(e, 0), coalesce(eh, 0), coalesce(el, 0))) AS graph_hash FROM
        (SELECT sample_id, count(*) AS n, sum(CAST('0x' || substr(md5(%s), 1, 16) AS UBIGINT)::HUGEINT) AS nh, sum(CAST('0x' || substr(md5(%s), 17, 16) AS UBIGINT)::HUGEINT) AS nl FROM nodes GROUP BY 1) LEFT JOIN
        (SELECT sample_id, count(*) AS e, sum(CAST('0x' || substr(md5(%s), 1, 16) AS UBIGINT)::HUGEINT) AS eh, sum(CAST('0x' || substr(md5(%s), 17, 16) AS UBIGINT)::HUGEINT) AS el FROM edges GROUP BY 1)
        USING (sample_id)""" % (NODE_JSON, NODE_JSON, EDGE_JSON, EDGE_JSON),
}
SHARES = ["node_coverage", "edge_coverage", "temporal_consistency", "hallucination_score", "overall_confidence"]
SHARE_COLS = ", ".join(f"{r6(s)} AS {s}" for s in SHARES)
COUNTS = "sample_id, language, scenario, parsed, nodes_total, nodes_mentioned, nodes_timed, edges_total, edges_expressed, hallucination_count, bad_nodes, bad_edges"
BREAK = """count(*) AS n, CAST(count(*) FILTER (decision = 'accept') AS BIGINT) AS n_accept, CAST(count(*) FILTER (decision = 'review') AS BIGINT) AS n_review,
    CAST(count(*) FILTER (decision = 'reject') AS BIGINT) AS n_reject"""
EXPECTED = [("total", 47714), ("decisions.accept", 41315), ("decisions.review", 4950), ("decisions.reject", 1449), ("accepted.en", 20982), ("accepted.de", 20333), ("participants", 3410)]


def v(body: str, **extra: str) -> str:
    return sql(body, **VERIFY, **extra)


ORACLE = {
    "verification_join": v("SELECT sample_id, node_id, mentioned, temporal_correct FROM jn"),
    "verifier_completeness": v("""SELECT sample_id, 'node' AS kind, node_id AS id, n_verdicts FROM jn WHERE n_verdicts <> 1
        UNION ALL SELECT sample_id, 'edge', edge_id, n_verdicts FROM je WHERE n_verdicts <> 1"""),
    "extra_time_references": v("SELECT sample_id, content, evidence FROM time_rows"),
    "merge_extra_content": v("SELECT sample_id, content, evidence FROM merged"),
    "verification_scores": v(f"SELECT {COUNTS}, {SHARE_COLS} FROM full_scores"),
    "decide_gate": v(f"SELECT sample_id, {DECIDE} AS decision FROM full_scores"),
    "decision_reason": v("""SELECT s.sample_id, s.decision, 'decision' AS kind, CAST(0 AS BIGINT) AS ord, CASE WHEN NOT parsed THEN 'verifier output unreadable'
          WHEN bad_nodes + bad_edges > 0 THEN 'verifier output incomplete, ids without exactly one verdict: ' || bad_nodes || ' nodes, ' || bad_edges || ' edges'
          WHEN decision = 'accept' THEN 'complete: ' || nodes_total || ' nodes, ' || edges_total || ' relations'
          ELSE 'unclear nodes: ' || coalesce(a, 0) || ', silent relations: ' || coalesce(b, 0) || ', wrong times: ' || coalesce(t, 0) || ', extras: ' || coalesce(x, 0) END AS item
        FROM stored s LEFT JOIN (SELECT sample_id, count(*) FILTER (kind = 'node') AS a, count(*) FILTER (kind = 'relation') AS b, count(*) FILTER (kind = 'timing') AS t,
          count(*) FILTER (kind = 'extra') AS x FROM issues GROUP BY 1) c ON c.sample_id = s.sample_id
        UNION ALL SELECT i.sample_id, s.decision, i.kind, CAST(i.ord AS BIGINT), i.item FROM issues i JOIN stored s ON s.sample_id = i.sample_id
        WHERE s.parsed AND s.bad_nodes + s.bad_edges = 0 AND s.decision <> 'accept'""", issues="""SELECT sample_id, 'node' AS kind, CAST(pos AS BIGINT) AS ord, label AS item FROM jn WHERE NOT mentioned
          UNION ALL SELECT e.sample_id, 'relation', e.edge_no, r.source_label || '->' || r.target_label FROM je e JOIN real_edges r ON r.sample_id = e.sample_id AND r.edge_id = e.edge_id WHERE NOT expressed
          UNION ALL SELECT sample_id, 'timing', pos, label || ' (expected ' || chr(39) || anchor || chr(39) || ')' FROM jn WHERE mentioned AND NOT temporal_correct
          UNION ALL SELECT sample_id, 'extra', row_number() OVER (PARTITION BY sample_id ORDER BY ord) - 1, content FROM merged"""),
    "forced_reject": v(f"""SELECT sample_id, CASE WHEN parsed THEN 'incomplete' ELSE 'unparsed' END AS verifier, bad_nodes, bad_edges, nodes_mentioned, {SHARE_COLS}, decision
        FROM stored WHERE NOT parsed OR bad_nodes + bad_edges > 0"""),
    "decision_breakdown": v(f"""SELECT facet, value, n, n_accept, n_review, n_reject, {r6('n_accept::DOUBLE / n')} AS accept_rate, {r6('n_review::DOUBLE / n')} AS review_rate,
        {r6('n_reject::DOUBLE / n')} AS reject_rate FROM (SELECT 'all' AS facet, 'all' AS value, {BREAK} FROM stored UNION ALL
        SELECT 'language', language, {BREAK} FROM stored GROUP BY 2 UNION ALL SELECT 'scenario', scenario, {BREAK} FROM stored GROUP BY 2)"""),
    "mean_scores": v(f"""SELECT {', '.join(f"{r6(f'avg({s})')} AS {s}" for s in SHARES)}, CAST(count(*) FILTER (hallucination_count > 0) AS BIGINT) AS samples_with_extras,
        count(DISTINCT participant_id) AS participants, count(DISTINCT day_index) AS days, count(*) AS samples FROM stored JOIN (SELECT sample_id, participant_id, day_index FROM samples) USING (sample_id)"""),
    "usage_ledger": v(f"""SELECT prompt_tokens, completion_tokens, llm_calls, samples, prompt_tokens + completion_tokens AS total_tokens, {r6('cost')} AS cost_usd,
        {r6('cost / samples')} AS cost_per_sample, {r6('cost / samples * 47714')} AS extrapolated_usd FROM (SELECT *, prompt_tokens / 1e6 * 0.15::DOUBLE + completion_tokens / 1e6 * 0.60::DOUBLE AS cost FROM
        (SELECT {big('sum(prompt_tokens)')} AS prompt_tokens, {big('sum(completion_tokens)')} AS completion_tokens, {big('sum(llm_calls)')} AS llm_calls, count(*) AS samples FROM samples))"""),
    "expectation_checks": v(f"""SELECT field, measured, CAST(expected AS BIGINT) AS expected, CASE WHEN measured = expected THEN 'PASS' ELSE 'FAIL' END AS verdict FROM (
        SELECT 'total' AS field, count(*) AS measured FROM recs UNION ALL SELECT 'decisions.' || d, (SELECT count(*) FROM recs WHERE decision = d) FROM (VALUES ('accept'), ('review'), ('reject')) x(d)
        UNION ALL SELECT 'accepted.' || g, (SELECT count(*) FROM recs WHERE decision = 'accept' AND language = g) FROM (VALUES ('en'), ('de')) y(g)
        UNION ALL SELECT 'participants', count(DISTINCT participant_id) FROM recs) JOIN (VALUES {', '.join(str(e) for e in EXPECTED)}) z(field, expected) USING (field)"""),
    "graph_hash": v("SELECT sample_id, graph_hash FROM hashes"),
    "pending_samples": v("SELECT sample_id, participant_id FROM samples WHERE (user_id + day_index) % 6 = 0"),
    "graph_drift": v("""SELECT state, count(*) AS n, min(sample_id) AS first_sample, bool_and(state = 'same') OVER () AS resumable FROM (
        SELECT coalesce(o.sample_id, n.sample_id) AS sample_id, CASE WHEN n.sample_id IS NULL THEN 'missing' WHEN o.sample_id IS NULL THEN 'new' WHEN o.version <> n.version THEN 'version'
        WHEN o.graph_hash <> n.graph_hash THEN 'content' ELSE 'same' END AS state FROM
        (SELECT sample_id, CASE WHEN user_id % 19 = 0 THEN 1 ELSE 2 END AS version, graph_hash FROM hashes JOIN samples USING (sample_id) WHERE (user_id + day_index) % 20 <> 0) o FULL JOIN
        (SELECT sample_id, 2 AS version, CASE WHEN day_index % 11 = 0 THEN sha1(graph_hash) ELSE graph_hash END AS graph_hash FROM hashes JOIN samples USING (sample_id) WHERE (user_id + day_index) % 20 <> 1) n
        ON o.sample_id = n.sample_id) GROUP BY 1"""),
    "pick_examples": v("""SELECT language, style_group, sample_id, decision FROM (SELECT *, row_number() OVER (PARTITION BY language, style_group ORDER BY
        CASE decision WHEN 'accept' THEN 1 WHEN 'review' THEN 2 ELSE 3 END, participant_id, day_index) AS r FROM (SELECT *, CASE WHEN writing_style IN ('terse_fragmented', 'matter_of_fact') THEN 'short'
        WHEN writing_style IN ('rambling', 'emotional') THEN 'long' END AS style_group FROM recs) WHERE style_group IS NOT NULL) WHERE r = 1"""),
    "filter_decision": v("SELECT sample_id, decision FROM recs WHERE decision IN ('accept', 'review')"),
    "language_fallback": v("SELECT sample_id, coalesce(nullif(record_language, ''), nullif(participant_language, ''), 'en') AS language FROM samples"),
    "filter_language": v("SELECT sample_id, language FROM samples WHERE language = 'de'"),
    "typepair_connectivity_accepted": v(f"""SELECT type_a, type_b, cooccur, connected, {r6('p')} AS p, CASE WHEN p >= 0.15::DOUBLE AND p <= 0.85::DOUBLE THEN 'OK' ELSE 'DEGEN' END AS flag FROM (
        SELECT type_a, type_b, count(*) AS cooccur, CAST(count(*) FILTER (n_edges > 0) AS BIGINT) AS connected, CAST(count(*) FILTER (n_edges > 0) AS DOUBLE) / count(*) AS p
        FROM pairs WHERE sample_id IN (SELECT sample_id FROM stored WHERE decision = 'accept') GROUP BY 1, 2) WHERE cooccur >= 30"""),
    "corpus_stats": v(f"""SELECT count(*) AS samples, count(DISTINCT participant_id) AS participants, {big("count(*) FILTER (decision = 'accept')")} AS accept, {big("count(*) FILTER (decision = 'review')")} AS review,
        {big("count(*) FILTER (decision = 'reject')")} AS reject, {big("count(*) FILTER (language = 'en')")} AS en_all, {big("count(*) FILTER (language = 'de')")} AS de_all,
        {big("count(*) FILTER (language = 'en' AND decision = 'accept')")} AS en_accepted, {big("count(*) FILTER (language = 'de' AND decision = 'accept')")} AS de_accepted,
        {big('min(age)')} AS age_min, {big('max(age)')} AS age_max, {r6('avg(age)')} AS age_mean, count(DISTINCT scenario) AS scenarios FROM recs"""),
    "frequency_tables": v("""SELECT facet, value, n, row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) AS rank FROM (SELECT 'style' AS facet, writing_style AS value, count(*) AS n FROM samples GROUP BY 2
        UNION ALL SELECT 'scenario', scenario, count(*) FROM samples GROUP BY 2 UNION ALL SELECT 'concept_type', type, count(*) FROM concepts GROUP BY 2
        UNION ALL SELECT 'polarity', polarity, count(*) FROM concepts GROUP BY 2)"""),
    "nearest_rank_percentiles": v(f"""SELECT measure, max(n) AS n, {', '.join(f"{big(f'max(v) FILTER (i = CAST(round_even({p} * (n - 1), 0) AS BIGINT))')} AS {name}" for name, p in [('min', '0.0::DOUBLE'), ('p25', '0.25::DOUBLE'), ('p50', '0.5::DOUBLE'), ('p75', '0.75::DOUBLE'), ('p90', '0.9::DOUBLE'), ('max', '1.0::DOUBLE')])}
        FROM (SELECT measure, v, row_number() OVER (PARTITION BY measure ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY measure) AS n FROM (
        SELECT 'nodes' AS measure, n_nodes AS v FROM samples UNION ALL SELECT 'edges', coalesce(e.n, 0) FROM samples s LEFT JOIN (SELECT sample_id, count(*) AS n FROM edges GROUP BY 1) e ON e.sample_id = s.sample_id
        UNION ALL SELECT 'words', len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) FROM texts)) GROUP BY 1"""),
}
