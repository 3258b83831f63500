"""SQL for the reading, writing and inspection queries."""

from daygraph.oracle.base import big, r6, sql
from daygraph.oracle.prepare import hexnum
from daygraph.oracle.text import TEXT


def s(body: str, **extra: str) -> str:
    return sql(body, **TEXT, **extra)


def dscore(*parts: str) -> str:
    joined = " || ':' || ".join(parts)
    return f"({hexnum(f'md5({joined})', 1, 6)} % 1000)::DOUBLE / 1000"


ORACLE = {
    "scan_samples": s(f"""SELECT x.sample_id, x.participant_id, {r6('x.mood_score')} AS mood_score, x.n_nodes, coalesce(e.n, 0) AS n_edges, {r6('coalesce(e.w, 0)')} AS weight
        FROM samples x LEFT JOIN (SELECT sample_id, count(*) AS n, sum(weight) AS w FROM edges GROUP BY 1) e ON e.sample_id = x.sample_id"""),
    "scan_torn_tail": s(f"SELECT sample_id, scenario, {big('age')} AS age FROM samples WHERE (user_id + day_index) % 50 <> 0"),
    "scan_concepts": s("SELECT concept_id, type, label, polarity FROM concepts"),
    "scan_split_map": s("SELECT participant_id, split FROM split_map"),
    "scan_relation_map": s("SELECT src_type, dst_type, relation, n FROM majority"),
    "scan_notes": s("SELECT sample_id, md5(raw) AS digest FROM notes"),
    "sink_examples_by_split": s(f"SELECT split, count(*) AS n, {big('count(*) FILTER (connected)')} AS positives FROM rex GROUP BY 1"),
    "sink_sorted_rewrite": s("SELECT participant_id, day_index, sample_id, row_number() OVER (ORDER BY participant_id, day_index) - 1 AS place FROM samples"),
    "sink_append": s("SELECT CAST(day_index % 2 AS INTEGER) AS batch, decision, count(*) AS n FROM recs GROUP BY 1, 2"),
    "sink_csv_table": s(f"""SELECT type_pair, count(*) AS n, {big('count(*) FILTER (connected)')} AS n_connected, printf('%.4f', round_even(count(*) FILTER (connected)::DOUBLE / count(*), 4)) AS p_connected FROM rex GROUP BY 1"""),
    "sink_json_summary": s("""SELECT CASE WHEN row_number() OVER (ORDER BY concept_id) = 1 THEN '{' ELSE '' END || '"' || concept_id || '":' || train_support
        || CASE WHEN row_number() OVER (ORDER BY concept_id DESC) = 1 THEN '}' ELSE ',' END AS line FROM idx"""),
    "lookup_participant_day": s("SELECT sample_id, scenario, n_nodes FROM samples WHERE participant_id = 'p00003' AND day_index = 2"),
    "lookup_line_index": s("SELECT sample_id, participant_id, day_index FROM (SELECT *, row_number() OVER (ORDER BY participant_id, day_index) AS n FROM samples) WHERE n = 101"),
    "inspect_card": s(f"""SELECT sample_id, CAST(1 AS BIGINT) AS section, pos AS ord, '[' || node_id || '] ' || label || ' (' || type || ', ' || polarity || ', ' || anchor || ')' AS line FROM nodes
        UNION ALL SELECT sample_id, 2, edge_no, source_node_id || ' --' || edge_type || '--> ' || target_node_id FROM edges
        UNION ALL SELECT sample_id, 3, 1, 'overall: ' || decision || ' nodes mentioned: ' || nodes_mentioned || '/' || nodes_total || ' edges expressed: ' || edges_expressed || '/' || edges_total FROM stored
        UNION ALL SELECT sample_id, 4, row_number() OVER (PARTITION BY sample_id ORDER BY ord) - 1, '- ' || trim(content) || ': "' || evidence || '"' FROM extras"""),
    "dataset_order": s("SELECT participant_id, day_index, sample_id FROM samples"),
    "extract_graphs": s(f"""SELECT sample_id, 'node' AS kind, node_id AS id, concept_id || '|' || type || '|' || polarity AS what, {r6('score')} AS score FROM xn
        UNION ALL SELECT p.sample_id, 'edge', CASE WHEN coalesce(r.n, 0) > coalesce(f.n, 0) THEN nb || '>' || na ELSE na || '>' || nb END,
        CASE WHEN coalesce(r.n, 0) > coalesce(f.n, 0) THEN r.relation ELSE coalesce(f.relation, 'linked_to') END, {r6('p.p')} FROM xp p
        LEFT JOIN majority f ON f.src_type = p.ta AND f.dst_type = p.tb LEFT JOIN majority r ON r.src_type = p.tb AND r.dst_type = p.ta WHERE p.p >= 0.39::DOUBLE""",
        td="SELECT sample_id, md5(text) AS d FROM texts WHERE text IS NOT NULL AND trim(text) <> ''",
        xr=f"""SELECT sample_id, concept_id, score, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, concept_id) AS rank, max(score) OVER (PARTITION BY sample_id) AS m
        FROM (SELECT t.sample_id, c.concept_id, {dscore('t.d', 'c.concept_id')} AS score FROM td t, concepts c)""",
        xn="""SELECT x.*, 'n' || rank AS node_id, c.type, c.polarity FROM xr x JOIN concepts c ON c.concept_id = x.concept_id
        WHERE score >= 0.28::DOUBLE OR (m < 0.28::DOUBLE AND rank <= 3)""",
        xp=f"""SELECT a.sample_id, a.node_id AS na, b.node_id AS nb, a.type AS ta, b.type AS tb, ({dscore('t.d', 'a.concept_id', 'b.concept_id')} + {dscore('t.d', 'b.concept_id', 'a.concept_id')}) / 2 AS p
        FROM xn a JOIN xn b ON b.sample_id = a.sample_id AND a.rank < b.rank JOIN td t ON t.sample_id = a.sample_id"""),
}
