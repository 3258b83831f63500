"""SQL for the preparation queries."""

from daygraph.oracle.base import big, r6, sql
from daygraph.oracle.verify import VERIFY
from daygraph.operators.prepare import ROUNDS


def hexnum(digest: str, start: int, n: int) -> str:
    return f"CAST('0x' || substr({digest}, {start}, {n}) AS BIGINT)"



def permuted(table: str, key: str, draws: str) -> str:
    """Rows of ``table`` (with ``total``) times ``draw`` and ``number``: the keyed order of the numbers below ``total``."""
    out = f"""SELECT *, draw // pr AS l, draw % pr AS r FROM (SELECT *, unnest(range(least(pl * pr, CAST(ceil(x + 12 * sqrt(x)) AS BIGINT) + 64))) AS draw FROM (
        SELECT *, ({draws}) * CAST(pl * pr AS DOUBLE) / total AS x FROM (SELECT *, 1::BIGINT << (length(bin(total - 1)) // 2) AS pl, 1::BIGINT << (length(bin(total - 1)) - length(bin(total - 1)) // 2) AS pr
        FROM {table} WHERE ({draws}) > 0)))"""
    for k in range(ROUNDS):
        to, by, size = ("l", "r", "pl") if k % 2 == 0 else ("r", "l", "pr")
        out = f"SELECT * REPLACE (({to} + {hexnum(f"md5('42:' || {key} || ':{k}:' || {by})", 1, 8)}) % {size} AS {to}) FROM ({out})"
    return f"SELECT *, l * pr + r AS number FROM ({out}) WHERE l * pr + r < total"


SHARE = lambda a, b: f"len(list_intersect(string_split({a}, '__'), string_split({b}, '__'))) > 0"

PREP = {
    **VERIFY,
    "kept_s": "SELECT * FROM recs WHERE decision = 'accept'",
    "split_map": """SELECT participant_id, language, CASE WHEN r <= round_even(n * 0.5::DOUBLE, 0) THEN 'train' WHEN r <= round_even(n * 0.5::DOUBLE, 0) + round_even(n * 0.3::DOUBLE, 0) THEN 'dev' ELSE 'test' END AS split
        FROM (SELECT participant_id, language, row_number() OVER (PARTITION BY language ORDER BY md5('42:' || language || ':' || participant_id)) AS r, count(*) OVER (PARTITION BY language) AS n
        FROM (SELECT DISTINCT participant_id, language FROM kept_s))""",
    "ks": "SELECT k.*, s.split FROM kept_s k JOIN split_map s ON s.participant_id = k.participant_id",
    "kn": "SELECT n.*, k.split FROM nodes n JOIN ks k ON k.sample_id = n.sample_id",
    "lab": "SELECT DISTINCT n.sample_id, n.concept_id, k.split FROM nodes n JOIN ks k ON k.sample_id = n.sample_id",
    "idx": "SELECT concept_id, count(*) AS train_support, row_number() OVER (ORDER BY concept_id) - 1 AS idx, count(*) >= 20 AS is_common FROM lab WHERE split = 'train' GROUP BY 1",
    "posp": """SELECT DISTINCT e.sample_id, least(e.source_pos, e.target_pos) AS lo, greatest(e.source_pos, e.target_pos) AS hi, least(e.source_node_id, e.target_node_id) AS node_a,
        greatest(e.source_node_id, e.target_node_id) AS node_b, least(e.src_type, e.dst_type) || '__' || greatest(e.src_type, e.dst_type) AS type_pair, k.split, k.language
        FROM real_edges e JOIN ks k ON k.sample_id = e.sample_id WHERE e.source_node_id <> e.target_node_id""",
    "rplan": """SELECT *, CASE WHEN want > 0 THEN want + p ELSE 0 END AS draws FROM (
        SELECT *, least(total - p, CAST(round_even(p * 1.0::DOUBLE, 0) AS BIGINT)) AS want FROM (
        SELECT k.sample_id, k.n_nodes * (k.n_nodes - 1) // 2 AS total, c.p, k.split, k.language FROM ks k JOIN (SELECT sample_id, count(*) AS p FROM posp GROUP BY 1) c ON c.sample_id = k.sample_id))""",
    "rdraw": permuted("rplan", "sample_id", "draws"),
    "rneg": """SELECT * FROM (SELECT d.sample_id, d.split, d.language, d.want, least(a.node_id, b.node_id) AS node_a, greatest(a.node_id, b.node_id) AS node_b,
        least(a.type, b.type) || '__' || greatest(a.type, b.type) AS type_pair, row_number() OVER (PARTITION BY d.sample_id ORDER BY d.draw) AS r
        FROM rdraw d JOIN (SELECT a.sample_id, a.pos AS lo, b.pos AS hi, (b.pos - 1) * (b.pos - 2) // 2 + a.pos - 1 AS i FROM nodes a JOIN nodes b ON a.sample_id = b.sample_id AND a.pos < b.pos) u
          ON u.sample_id = d.sample_id AND u.i = d.number
        JOIN nodes a ON a.sample_id = d.sample_id AND a.pos = u.lo JOIN nodes b ON b.sample_id = d.sample_id AND b.pos = u.hi
        LEFT JOIN posp p ON p.sample_id = d.sample_id AND p.lo = u.lo AND p.hi = u.hi WHERE p.sample_id IS NULL) WHERE r <= want""",
    "rex": """SELECT sample_id || '__' || node_a || '__' || node_b AS example_id, * FROM (SELECT sample_id, node_a, node_b, type_pair, split, language, TRUE AS connected FROM posp
        UNION ALL SELECT sample_id, node_a, node_b, type_pair, split, language, FALSE FROM rneg)""",
}

HARD = {
    **PREP,
    "np": "SELECT split, type_pair, count(*) AS n_pos FROM posp GROUP BY 1, 2",
    "cells": """SELECT *, CAST(coalesce(sum(c) OVER (PARTITION BY split, type_pair ORDER BY md5(sample_id), sample_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM (
        SELECT a.sample_id, a.split, least(a.type, b.type) AS type_a, greatest(a.type, b.type) AS type_b, least(a.type, b.type) || '__' || greatest(a.type, b.type) AS type_pair, count(*) AS c
        FROM kn a JOIN kn b ON b.sample_id = a.sample_id AND a.pos < b.pos GROUP BY 1, 2, 3, 4, 5)""",
    "base": """SELECT t.split, t.type_pair, CAST(t.total AS BIGINT) AS total, coalesce(n.n_pos, 0) AS n_pos, coalesce(n.n_pos, 0) AS target, CAST(t.total - coalesce(n.n_pos, 0) AS BIGINT) AS pool,
        CAST(least(coalesce(n.n_pos, 0), t.total - coalesce(n.n_pos, 0)) AS BIGINT) AS own
        FROM (SELECT split, type_pair, sum(c) AS total FROM cells GROUP BY 1, 2) t LEFT JOIN np n ON n.split = t.split AND n.type_pair = t.type_pair""",
    "short": "SELECT split, type_pair AS short_pair, target - own AS need, row_number() OVER (PARTITION BY split ORDER BY type_pair) AS i FROM base WHERE target > own",
    "fill(split, type_pair, step, remaining, stand_in)": f"""SELECT split, type_pair, CAST(0 AS BIGINT), pool - own, CAST(0 AS BIGINT) FROM base
        UNION ALL SELECT split, type_pair, step + 1, remaining - moved, stand_in + moved FROM (
          SELECT *, CAST(greatest(0, least(remaining, need - coalesce(sum(remaining) OVER (PARTITION BY split ORDER BY near DESC, remaining DESC, type_pair ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS moved
          FROM (SELECT f.*, s.need, {SHARE('f.type_pair', 's.short_pair')} AS near FROM fill f JOIN short s ON s.split = f.split AND s.i = f.step + 1))""",
    "hplan": """SELECT b.*, f.stand_in, b.own + f.stand_in AS take FROM base b JOIN fill f ON f.split = b.split AND f.type_pair = b.type_pair
        AND f.step = (SELECT count(*) FROM short s WHERE s.split = b.split)""",
    "hdraw": permuted("(SELECT * FROM hplan WHERE take > 0)", "split || ':' || type_pair", "take + n_pos"),
    "trank": "SELECT sample_id, type, pos, node_id, row_number() OVER (PARTITION BY sample_id, type ORDER BY pos) - 1 AS r, count(*) OVER (PARTITION BY sample_id, type) AS n FROM kn",
    "units": """SELECT a.sample_id, least(a.type, b.type) || '__' || greatest(a.type, b.type) AS type_pair, least(a.pos, b.pos) AS lo, greatest(a.pos, b.pos) AS hi, least(a.node_id, b.node_id) AS node_a,
        greatest(a.node_id, b.node_id) AS node_b, CASE WHEN a.type = b.type THEN b.r * (b.r - 1) // 2 + a.r ELSE a.r * b.n + b.r END AS local
        FROM trank a JOIN trank b ON b.sample_id = a.sample_id AND (a.type < b.type OR (a.type = b.type AND a.r < b.r))""",
    "hneg": """SELECT * FROM (SELECT d.split, d.type_pair, d.take, u.sample_id, u.node_a, u.node_b, row_number() OVER (PARTITION BY d.split, d.type_pair ORDER BY d.draw) AS r
        FROM hdraw d JOIN (SELECT c.split, c.type_pair, c.sample_id, c.start + u.local AS number, u.lo, u.hi, u.node_a, u.node_b FROM cells c JOIN units u ON u.sample_id = c.sample_id AND u.type_pair = c.type_pair) u
          ON u.split = d.split AND u.type_pair = d.type_pair AND u.number = d.number
        LEFT JOIN posp p ON p.sample_id = u.sample_id AND p.lo = u.lo AND p.hi = u.hi WHERE p.sample_id IS NULL) WHERE r <= take""",
    "hrep": """SELECT h.split, h.type_pair, h.n_pos, h.target, h.pool, h.take, h.stand_in, greatest(0, h.target - h.pool) AS deficit, coalesce(g.n, 0) AS achieved
        FROM hplan h LEFT JOIN (SELECT split, type_pair, count(*) AS n FROM hneg GROUP BY 1, 2) g ON g.split = h.split AND g.type_pair = h.type_pair""",
}


def p(body: str, **extra: str) -> str:
    return sql(body, **PREP, **extra)


def hard(body: str) -> str:
    return sql(body, **HARD).replace("WITH ", "WITH RECURSIVE ", 1)


def payload(n: str) -> str:
    return (f"'{{\"node_id\":\"' || {n}.node_id || '\",\"concept_id\":\"' || {n}.concept_id || '\",\"label\":\"' || {n}.label || '\",\"type\":\"' || {n}.type || '\",\"polarity\":\"' || {n}.polarity"
            f" || '\",\"anchor\":\"' || {n}.anchor || '\",\"day_offset\":' || {n}.day_offset || '}}'")


ORACLE = {
    "stratified_split": p("SELECT participant_id, language, split FROM split_map"),
    "assign_split": p("SELECT sample_id, participant_id, split FROM ks"),
    "node_examples": p("""SELECT k.sample_id AS example_id, k.participant_id, k.day_index, k.language, t.text, l.labels, l.label_surface, k.n_nodes AS num_nodes FROM kept_s k JOIN texts t ON t.sample_id = k.sample_id
        JOIN (SELECT sample_id, string_agg(DISTINCT concept_id, ',' ORDER BY concept_id) AS labels, string_agg(DISTINCT label, ',' ORDER BY label) AS label_surface FROM nodes GROUP BY 1) l ON l.sample_id = k.sample_id"""),
    "label_index": p("SELECT concept_id, train_support, idx, is_common FROM idx"),
    "rare_labels": p("SELECT concept_id, train_support FROM idx ORDER BY train_support, concept_id LIMIT 15"),
    "unseen_labels": p("""SELECT split, count(DISTINCT sample_id) AS examples, count(*) AS labels FROM fine WHERE l NOT IN (SELECT l FROM fine WHERE split = 'train') GROUP BY 1""",
        fine="SELECT DISTINCT n.sample_id, n.concept_id || '_' || (n.event_id % 977) AS l, k.split FROM nodes n JOIN ks k ON k.sample_id = n.sample_id"),
    "split_report": p(f"""SELECT m.split, m.n AS participants, m.en AS participants_en, m.de AS participants_de, e.n AS examples, e.en AS examples_en, e.de AS examples_de, {r6('e.en::DOUBLE / e.n')} AS en_share, r.positives, r.negatives
        FROM (SELECT split, count(*) AS n, {big("count(*) FILTER (language = 'en')")} AS en, {big("count(*) FILTER (language = 'de')")} AS de FROM split_map GROUP BY 1) m
        LEFT JOIN (SELECT split, count(*) AS n, {big("count(*) FILTER (language = 'en')")} AS en, {big("count(*) FILTER (language = 'de')")} AS de FROM ks GROUP BY 1) e ON e.split = m.split
        LEFT JOIN (SELECT split, {big("count(*) FILTER (connected)")} AS positives, {big("count(*) FILTER (NOT connected)")} AS negatives FROM rex GROUP BY 1) r ON r.split = m.split"""),
    "split_checks": p(f"""SELECT 'map disjoint' AS rule, {r6('count(*)')} AS value, count(*) = 0 AS ok FROM (SELECT participant_id FROM split_map GROUP BY 1 HAVING count(DISTINCT split) > 1)
        UNION ALL SELECT 'examples disjoint', {r6('count(*)')}, count(*) = 0 FROM (SELECT participant_id FROM ks GROUP BY 1 HAVING count(DISTINCT split) > 1)
        UNION ALL SELECT 'language share spread', {r6('max(en) - min(en)')}, max(en) - min(en) < 0.02::DOUBLE FROM (SELECT split, count(*) FILTER (language = 'en')::DOUBLE / count(*) AS en FROM ks GROUP BY 1)
        UNION ALL SELECT 'common labels below minimum', {r6('count(*)')}, count(*) = 0 FROM idx WHERE is_common AND train_support < 20"""),
    "split_intersections": p("""SELECT a || '&' || b AS splits, (SELECT count(*) FROM (SELECT participant_id FROM ks WHERE split = a INTERSECT SELECT participant_id FROM ks WHERE split = b)) AS shared
        FROM (VALUES ('train', 'dev'), ('train', 'test'), ('dev', 'test')) v(a, b)"""),
    "pool_minus_vocab": p("""SELECT concept_id, 'pool only' AS side FROM (SELECT concept_id FROM concepts EXCEPT SELECT concept_id FROM lab WHERE split = 'train' AND concept_id NOT LIKE '%_02')
        UNION ALL SELECT concept_id, 'label only' FROM (SELECT concept_id FROM lab WHERE split = 'train' AND concept_id NOT LIKE '%_02' EXCEPT SELECT concept_id FROM concepts)"""),
    "edge_examples_project": p(f"""SELECT x.example_id, {payload('a')} AS payload_a, {payload('b')} AS payload_b, x.connected, k.n_nodes AS graph_num_nodes, e.n AS graph_num_edges FROM rex x
        JOIN nodes a ON a.sample_id = x.sample_id AND a.node_id = x.node_a JOIN nodes b ON b.sample_id = x.sample_id AND b.node_id = x.node_b JOIN ks k ON k.sample_id = x.sample_id
        LEFT JOIN (SELECT sample_id, count(*) AS n FROM edges GROUP BY 1) e ON e.sample_id = x.sample_id"""),
    "entry_of_example": p("SELECT example_id, string_split(example_id, '__')[1] AS entry FROM rex"),
    "negatives_random": p("SELECT sample_id, node_a, node_b, type_pair FROM rneg"),
    "union_pos_neg": p("SELECT example_id, split, language, type_pair, connected FROM rex"),
    "connected_fraction": p(f"SELECT split, count(*) AS n, {r6('avg(connected::INTEGER)')} AS connected_fraction FROM rex GROUP BY 1"),
    "typepair_from_examples": p(f"""SELECT *, row_number() OVER (ORDER BY n DESC, type_pair) AS rank FROM (SELECT type_pair, count(*) AS n, {big('count(*) FILTER (connected)')} AS n_connected,
        {r6('count(*) FILTER (connected)::DOUBLE / count(*)')} AS p_connected FROM rex WHERE split = 'train' GROUP BY 1)"""),
    "largest_remainder": p(f"""SELECT split, type_pair, n_pos, {big('base + CASE WHEN r <= goal - used THEN 1 ELSE 0 END')} AS target FROM (
        SELECT *, sum(base) OVER (PARTITION BY split) AS used, row_number() OVER (PARTITION BY split ORDER BY rest DESC, type_pair) AS r FROM (
        SELECT *, (goal * n_pos) // total AS base, (goal * n_pos) % total AS rest FROM (SELECT *, CAST(round_even(total * 0.7::DOUBLE, 0) AS BIGINT) AS goal FROM (
        SELECT split, type_pair, count(*) AS n_pos, CAST(sum(count(*)) OVER (PARTITION BY split) AS BIGINT) AS total FROM posp GROUP BY 1, 2))))"""),
    "negatives_hard": hard("SELECT split, sample_id, node_a, node_b, type_pair FROM hneg"),
    "negatives_hard_report": hard(f"SELECT split, type_pair, n_pos, target, pool, take, stand_in, {big('deficit')} AS deficit, achieved FROM hrep"),
    "tv_distance": hard(f"""SELECT split, type_pair, n_pos, n_neg, {r6('pos_share')} AS pos_share, {r6('neg_share')} AS neg_share, {r6('sum(abs(pos_share - neg_share)) OVER (PARTITION BY split) * 0.5')} AS tv FROM (
        SELECT split, type_pair, n_pos, achieved AS n_neg, n_pos::DOUBLE / sum(n_pos) OVER (PARTITION BY split) AS pos_share, achieved::DOUBLE / sum(achieved) OVER (PARTITION BY split) AS neg_share FROM hrep)"""),
    "sample_per_cell": p("""SELECT example_id, language, connected FROM (SELECT *, row_number() OVER (PARTITION BY language, connected ORDER BY md5('42:' || example_id), example_id) AS r FROM rex) WHERE r <= 500"""),
    "sample_entries_fraction": p("""SELECT sample_id AS entry, count(*) AS pairs FROM rex WHERE split = 'train' AND sample_id IN (SELECT sample_id FROM (SELECT sample_id, row_number() OVER (ORDER BY md5('42:' || sample_id)) AS r,
        count(*) OVER () AS n FROM (SELECT DISTINCT sample_id FROM rex WHERE split = 'train')) WHERE r <= round_even(n * 0.3::DOUBLE, 0)) GROUP BY 1"""),
    "sample_by_entry": p("SELECT example_id, connected FROM rex WHERE sample_id IN (SELECT sample_id FROM samples WHERE n_nodes >= 5)"),
    "shared_type_pairs": p("""SELECT a.type_pair, count(*) AS n_near, string_agg(b.type_pair, ',' ORDER BY b.type_pair) AS near, (SELECT count(*) FROM tps) - 1 - count(*) AS n_far FROM tps a JOIN tps b ON a.type_pair <> b.type_pair
        AND %s GROUP BY 1""" % SHARE("a.type_pair", "b.type_pair"), tps="SELECT DISTINCT type_pair FROM rex"),
    "head_subset": p("SELECT split, sample_id, n FROM (SELECT split, sample_id, row_number() OVER (PARTITION BY split ORDER BY sample_id) AS n FROM ks) WHERE n <= 100"),
}
