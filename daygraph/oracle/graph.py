"""SQL for the graph queries; pairs are listed outright here."""

from daygraph import constants as C
from daygraph.oracle.base import big, r6, sql

PAIRS = {
    "all_pairs": """SELECT a.sample_id, a.node_id AS node_a, b.node_id AS node_b, a.type AS ta, b.type AS tb,
        least(a.type, b.type) AS type_a, greatest(a.type, b.type) AS type_b
        FROM nodes a JOIN nodes b ON a.sample_id = b.sample_id AND a.node_id < b.node_id""",
    "real_edges": """SELECT e.*, s.type AS src_type, t.type AS dst_type, s.concept_id AS source_concept_id, t.concept_id AS target_concept_id,
        s.label AS source_label, t.label AS target_label, s.pos AS source_pos, t.pos AS target_pos
        FROM edges e JOIN nodes s ON s.sample_id = e.sample_id AND s.node_id = e.source_node_id
        JOIN nodes t ON t.sample_id = e.sample_id AND t.node_id = e.target_node_id""",
    "conn": """SELECT sample_id, least(source_node_id, target_node_id) AS node_a, greatest(source_node_id, target_node_id) AS node_b,
        count(*) AS n_edges FROM real_edges WHERE source_node_id <> target_node_id GROUP BY 1, 2, 3""",
    "pairs": """SELECT p.*, coalesce(c.n_edges, 0) AS n_edges FROM all_pairs p LEFT JOIN conn c
        ON c.sample_id = p.sample_id AND c.node_a = p.node_a AND c.node_b = p.node_b""",
    "tp": """SELECT type_a, type_b, count(*) AS cooccur, CAST(count(*) FILTER (n_edges > 0) AS BIGINT) AS connected,
        CAST(count(*) FILTER (n_edges > 0) AS DOUBLE) / count(*) AS p FROM pairs GROUP BY 1, 2""",
    "majority": """SELECT src_type, dst_type, relation, n FROM (SELECT src_type, dst_type, edge_type AS relation, count(*) AS n,
        row_number() OVER (PARTITION BY src_type, dst_type ORDER BY count(*) DESC, edge_type) AS r
        FROM real_edges GROUP BY 1, 2, 3) WHERE r = 1""",
}

COMPAT_VALUES = ", ".join(str(row) for row in C.PLAUSIBLE_RELATION)


def refine(rel: str, src: str, sp: str, tp: str) -> str:
    return f"""CASE WHEN {rel} IS NULL THEN NULL WHEN {src} = 'coping_action' THEN (CASE WHEN {tp} = 'negative' THEN 'decreases' ELSE 'causes' END)
        WHEN {rel} IN ('increases', 'decreases') AND (({sp} = 'positive' AND {tp} = 'negative') OR ({sp} = 'negative' AND {tp} = 'positive')) THEN 'decreases'
        WHEN {rel} IN ('increases', 'decreases') AND {sp} IN ('positive', 'negative') AND {sp} = {tp} THEN 'increases' ELSE {rel} END"""


LOW, HIGH = C.BAND
ORACLE = {
    "graph_pairs": sql("SELECT sample_id, type_a, type_b, count(*) AS n_pairs FROM all_pairs GROUP BY 1, 2, 3", **PAIRS),
    "edge_endpoints": sql("""SELECT sample_id, edge_id, source_node_id, target_node_id, source_concept_id, target_concept_id, edge_type, weight
        FROM real_edges WHERE source_node_id <> target_node_id""", **PAIRS),
    "pair_connected": sql("SELECT sample_id, node_a, node_b, ta AS type_a, tb AS type_b, n_edges, TRUE AS connected FROM pairs WHERE n_edges > 0", **PAIRS),
    "negative_candidates": sql(f"""SELECT sample_id, type_a, type_b, count(*) AS n_pairs, {big('count(*) FILTER (n_edges > 0)')} AS n_connected,
        {big('count(*) FILTER (n_edges = 0)')} AS n_candidates FROM pairs GROUP BY 1, 2, 3 HAVING count(*) FILTER (n_edges = 0) > 0""", **PAIRS),
    "typepair_connectivity": sql(f"SELECT type_a, type_b, cooccur, connected, {r6('p')} AS p FROM tp", **PAIRS),
    "band_flag": sql(f"""SELECT type_a, type_b, cooccur, connected, {r6('p')} AS p,
        CASE WHEN cooccur < 30 THEN '' WHEN p > CAST({LOW} AS DOUBLE) AND p < CAST({HIGH} AS DOUBLE) THEN 'ok' ELSE 'OUT' END AS strict_flag,
        CASE WHEN cooccur < 30 THEN '' WHEN p >= CAST({LOW} AS DOUBLE) AND p <= CAST({HIGH} AS DOUBLE) THEN 'OK' ELSE 'DEGEN' END AS closed_flag,
        CASE WHEN cooccur < (SELECT CASE WHEN count(*) < 2000 THEN 15 ELSE 100 END FROM samples) THEN ''
             WHEN p > CAST({LOW} AS DOUBLE) AND p < CAST({HIGH} AS DOUBLE) THEN 'ok' ELSE 'OUT' END AS run_flag FROM tp""", **PAIRS),
    "unresolved_nodes": sql("""SELECT sample_id, node_id, concept_id, type, label, polarity, anchor FROM nodes
        WHERE type IN ('stressor', 'symptom', 'emotion', 'event') AND polarity = 'negative' AND day_offset >= 0"""),
    "verbalise_edges": sql("""SELECT sample_id, edge_id, source_label || ' ' || CASE edge_type WHEN 'causes' THEN 'because of' WHEN 'increases' THEN 'which made worse'
        WHEN 'decreases' THEN 'which helped with' WHEN 'follows' THEN 'after' WHEN 'linked_to' THEN 'around the same time as' ELSE edge_type END
        || ' ' || target_label AS relation FROM real_edges""", **PAIRS),
    "compat_relation": sql(f"""SELECT type_a, polarity_a, type_b, polarity_b, n_unconnected, coalesce(fwd, bwd) AS relation,
        CASE WHEN fwd IS NOT NULL THEN type_a WHEN bwd IS NOT NULL THEN type_b END AS source_type,
        CASE WHEN fwd IS NOT NULL THEN type_b WHEN bwd IS NOT NULL THEN type_a END AS target_type FROM (
        SELECT g.*, {refine('f.rel', 'type_a', 'polarity_a', 'polarity_b')} AS fwd, {refine('b.rel', 'type_b', 'polarity_b', 'polarity_a')} AS bwd FROM (
          SELECT a.type AS type_a, a.polarity AS polarity_a, b.type AS type_b, b.polarity AS polarity_b, count(*) AS n_unconnected
          FROM nodes a JOIN nodes b ON a.sample_id = b.sample_id AND a.pos < b.pos
          LEFT JOIN conn c ON c.sample_id = a.sample_id AND c.node_a = least(a.node_id, b.node_id) AND c.node_b = greatest(a.node_id, b.node_id)
          WHERE c.sample_id IS NULL GROUP BY 1, 2, 3, 4) g
        LEFT JOIN compat f ON f.s = type_a AND f.t = type_b LEFT JOIN compat b ON b.s = type_b AND b.t = type_a)""",
        **PAIRS, compat=f"SELECT * FROM (VALUES {COMPAT_VALUES}) v(s, t, rel)"),
    "relation_majority": sql("SELECT src_type, dst_type, relation, n FROM majority", **PAIRS),
    "relation_pick": sql("""SELECT type_a, type_b, coalesce(r.n, 0) > coalesce(f.n, 0) AS reversed,
        CASE WHEN coalesce(r.n, 0) > coalesce(f.n, 0) THEN type_b ELSE type_a END AS src_type,
        CASE WHEN coalesce(r.n, 0) > coalesce(f.n, 0) THEN type_a ELSE type_b END AS dst_type,
        CASE WHEN coalesce(r.n, 0) > coalesce(f.n, 0) THEN r.relation ELSE coalesce(f.relation, 'linked_to') END AS relation
        FROM (SELECT src_type AS type_a, dst_type AS type_b FROM real_edges WHERE source_node_id <> target_node_id
              UNION SELECT dst_type, src_type FROM real_edges WHERE source_node_id <> target_node_id) p
        LEFT JOIN majority f ON f.src_type = type_a AND f.dst_type = type_b LEFT JOIN majority r ON r.src_type = type_b AND r.dst_type = type_a""", **PAIRS),
    "concept_lookup": sql("""SELECT sample_id, node_id, i.concept_id, coalesce(p.type, 'unknown') AS type, coalesce(p.label, i.concept_id) AS label,
        coalesce(p.polarity, 'neutral') AS polarity FROM (SELECT sample_id, node_id, CASE WHEN event_id % 83 = 0 THEN 'other_' || k ELSE concept_id END AS concept_id FROM nodes) i
        LEFT JOIN concepts p ON p.concept_id = i.concept_id"""),
    "day_polarity": sql(f"""SELECT sample_id, {big("sum(CASE WHEN type IN ('emotion', 'symptom') THEN CASE polarity WHEN 'positive' THEN 1 WHEN 'negative' THEN -1 ELSE 0 END ELSE 0 END)")} AS day_polarity
        FROM nodes GROUP BY 1"""),
    "node_degree": sql("""SELECT n.sample_id, n.node_id, count(d.node_id) AS degree FROM nodes n LEFT JOIN
        (SELECT sample_id, source_node_id AS node_id FROM edges UNION ALL SELECT sample_id, target_node_id FROM edges) d
        ON d.sample_id = n.sample_id AND d.node_id = n.node_id GROUP BY 1, 2"""),
    "droppable_edges": sql("""SELECT e.sample_id, e.edge_id, e.source_node_id, e.target_node_id FROM edges e
        WHERE (e.sample_id, e.source_node_id) IN (SELECT sample_id, node_id FROM busy) AND (e.sample_id, e.target_node_id) IN (SELECT sample_id, node_id FROM busy)""",
        busy="""SELECT sample_id, node_id FROM (SELECT sample_id, source_node_id AS node_id FROM edges UNION ALL SELECT sample_id, target_node_id FROM edges)
        GROUP BY 1, 2 HAVING count(*) > 1"""),
}
