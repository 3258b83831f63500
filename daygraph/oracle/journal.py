"""SQL for the journal queries."""

from daygraph.oracle.base import big, r6, sql
from daygraph.oracle.graph import PAIRS
from daygraph.oracle.text import clean


def day(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d')"


def fixed1(e: str) -> str:
    return f"printf('%.1f', round({r6(e)}, 1) + 0.0)"


JOURNAL = {
    **{k: PAIRS[k] for k in ("real_edges",)},
    "entries": f"SELECT s.sample_id, s.participant_id, s.entry_date, s.mood_score, length({clean('t.text')}) >= 15 AS eligible FROM samples s JOIN texts t ON t.sample_id = s.sample_id",
    "meta": """SELECT participant_id, concept_id, type, label, polarity, type IN ('stressor', 'symptom', 'emotion', 'thought', 'event') AND polarity <> 'positive' AS problem,
        type = 'coping_action' OR (type = 'activity' AND polarity = 'positive') AS coping FROM
        (SELECT *, row_number() OVER (PARTITION BY participant_id, concept_id ORDER BY entry_date, sample_id, pos) AS r FROM nodes) WHERE r = 1""",
    "cdates": "SELECT DISTINCT participant_id, concept_id, entry_date FROM nodes",
    "jdays": """SELECT *, row_number() OVER (PARTITION BY participant_id ORDER BY entry_date) AS day_no, count(*) OVER (PARTITION BY participant_id) AS total_days,
        lag(entry_date) OVER (PARTITION BY participant_id ORDER BY entry_date) AS previous FROM
        (SELECT participant_id, entry_date, arg_min(mood_score, sample_id) FILTER (mood_score IS NOT NULL) AS mood, count(*) AS n_entries FROM entries GROUP BY 1, 2)""",
    "span": """SELECT participant_id, CAST(sum(n_entries) AS BIGINT) AS entries, count(*) AS total_days, min(entry_date) AS first_date, max(entry_date) AS last_date,
        CAST(date_diff('day', min(entry_date), max(entry_date)) + 1 AS BIGINT) AS span_days, CAST(max(date_diff('day', previous, entry_date)) - 1 AS BIGINT) AS gap_days FROM jdays GROUP BY 1""",
    "moods": "SELECT participant_id, entry_date, mood FROM jdays WHERE mood IS NOT NULL",
    "baseline": "SELECT participant_id, avg(mood) AS baseline, count(*) AS n_moods FROM moods GROUP BY 1 HAVING count(*) >= 2",
    "cdays": "SELECT participant_id, concept_id, count(*) AS days, min(entry_date) AS first_date, max(entry_date) AS last_date FROM cdates GROUP BY 1, 2",
    "known": "SELECT c.*, m.type, m.label, m.polarity, m.problem, m.coping, s.total_days FROM cdays c JOIN meta m USING (participant_id, concept_id) JOIN span s USING (participant_id)",
    "recurring": """SELECT *, row_number() OVER (PARTITION BY participant_id ORDER BY days DESC, concept_id) AS rank FROM (
        SELECT *, CAST(CASE WHEN total_days < 5 THEN 2 ELSE greatest(3, ceil(0.2::DOUBLE * total_days)) END AS BIGINT) AS threshold FROM known WHERE problem) WHERE days >= threshold""",
    "halves": """SELECT r.participant_id, r.concept_id, r.days, r.total_days, r.rank, CAST(count(*) FILTER (d.day_no <= r.total_days // 2) AS BIGINT) AS first_days,
        CAST(count(*) FILTER (d.day_no > r.total_days // 2) AS BIGINT) AS second_days FROM recurring r JOIN cdates c USING (participant_id, concept_id)
        JOIN jdays d ON d.participant_id = r.participant_id AND d.entry_date = c.entry_date WHERE r.total_days >= 4 GROUP BY 1, 2, 3, 4, 5""",
    "coping_dates": "SELECT DISTINCT c.participant_id, c.entry_date FROM cdates c JOIN meta m USING (participant_id, concept_id) WHERE m.coping",
    "never": """SELECT * FROM recurring r WHERE participant_id IN (SELECT participant_id FROM coping_dates) AND NOT EXISTS (SELECT 1 FROM cdates c JOIN coping_dates x
        ON x.participant_id = c.participant_id AND x.entry_date = c.entry_date WHERE c.participant_id = r.participant_id AND c.concept_id = r.concept_id)""",
    "chains": """SELECT * FROM (SELECT e.sample_id, row_number() OVER (PARTITION BY e.sample_id ORDER BY e.source_pos, e.edge_no, f.edge_no) AS path_no,
        e.source_concept_id AS a, e.target_concept_id AS b, f.target_concept_id AS c, e.edge_type AS relation_1, f.edge_type AS relation_2
        FROM real_edges e JOIN real_edges f ON f.sample_id = e.sample_id AND f.source_node_id = e.target_node_id
        WHERE e.source_concept_id <> e.target_concept_id AND f.source_concept_id <> f.target_concept_id AND f.target_concept_id <> e.source_concept_id) WHERE path_no <= 50""",
    "top_chains": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY participant_id ORDER BY days DESC, a, b, c) AS rank FROM (
        SELECT participant_id, a, b, c, count(DISTINCT entry_date) AS days, arg_min(relation_1, (entry_date, sample_id, path_no)) AS relation_1,
        arg_min(relation_2, (entry_date, sample_id, path_no)) AS relation_2 FROM chains JOIN entries USING (sample_id) GROUP BY 1, 2, 3, 4) JOIN span USING (participant_id)
        WHERE days >= CASE WHEN total_days < 5 THEN 1 ELSE 2 END) WHERE rank <= 5""",
    "coping": "SELECT * FROM known WHERE coping AND days >= 2",
    "next_day": "SELECT m.participant_id, m.entry_date, m.mood, n.mood AS next_mood, n.mood - m.mood AS shift FROM moods m JOIN moods n ON n.participant_id = m.participant_id AND n.entry_date = m.entry_date + 1",
    "low_mood": """SELECT * FROM (SELECT participant_id, strftime(entry_date, '%A') AS weekday, avg(mood) AS mean, count(*) AS n FROM moods GROUP BY 1, 2) JOIN baseline USING (participant_id)
        WHERE n_moods >= 6 AND n >= 2 AND baseline - mean >= 1.0""",
    "clusters": """SELECT participant_id, weekday, n, CAST(total AS BIGINT) AS total FROM (SELECT *, sum(n) OVER (PARTITION BY participant_id) AS total, count(*) OVER (PARTITION BY participant_id) AS weekdays,
        row_number() OVER (PARTITION BY participant_id ORDER BY n DESC, weekday) AS r FROM (SELECT c.participant_id, strftime(c.entry_date, '%A') AS weekday, count(*) AS n
        FROM cdates c JOIN meta m USING (participant_id, concept_id) WHERE m.type = 'stressor' GROUP BY 1, 2)) JOIN span USING (participant_id)
        WHERE r = 1 AND total >= 6 AND total_days >= 7 AND weekdays > 1 AND n >= total * 0.4::DOUBLE""",
    "points0": f"""SELECT h.participant_id, 1 AS kind, h.concept_id AS key, second_days - first_days + h.days::DOUBLE / total_days AS strength,
          '**' || label || '** grew from the first to the second half (' || first_days || ' → ' || second_days || ' days). What was different later?' AS text
        FROM halves h JOIN meta USING (participant_id, concept_id) WHERE second_days >= first_days * 1.5::DOUBLE AND second_days - first_days >= 2
        UNION ALL SELECT participant_id, 2, concept_id, days::DOUBLE / total_days + 0.5::DOUBLE, '**' || label || '** (' || days ||
          ' days) never met a coping action. What has been tried?' FROM never
        UNION ALL SELECT t.participant_id, 3, a || '→' || b || '→' || c, days::DOUBLE / total_days + 0.4::DOUBLE, 'Chain **' || replace(a, '_', ' ') || ' → ' || replace(b, '_', ' ') || ' → ' || replace(c, '_', ' ') ||
          '** came back on ' || days || ' days. Where could it be broken?' FROM top_chains t WHERE rank = 1 AND days >= 2
        UNION ALL SELECT participant_id, 4, weekday, (baseline - mean) / 2, '**' || weekday || 's** have mood ' || {fixed1('mean')} || ' vs ' || {fixed1('baseline')} || ' overall (' || n || ' ' || weekday ||
          's). What does that weekday bring?' FROM low_mood
        UNION ALL SELECT participant_id, 5, weekday, n::DOUBLE / total, 'Stressors gather on **' || weekday || 's** (' || n || ' of ' || total || '). What fills that day?' FROM clusters""",
    "points": f"""SELECT * FROM (SELECT participant_id, kind, key, {r6('strength')} AS strength, text,
        row_number() OVER (PARTITION BY participant_id ORDER BY {r6('strength')} DESC, kind, key) AS rank FROM points0) WHERE rank <= 5""",
    "numbered": "SELECT *, row_number() OVER (PARTITION BY participant_id ORDER BY entry_date, sample_id) AS entry_no FROM entries",
    "dayref": """SELECT e.participant_id, e.sample_id, e.entry_date, e.mood_score, coalesce(t.tops, '—') AS top_concepts FROM entries e LEFT JOIN (
        SELECT sample_id, string_agg(label, ', ' ORDER BY r) AS tops FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY confidence DESC, pos) AS r FROM (
          SELECT *, row_number() OVER (PARTITION BY sample_id, concept_id ORDER BY confidence DESC, pos) AS d FROM nodes) WHERE d = 1) WHERE r <= 5 GROUP BY 1) t ON t.sample_id = e.sample_id""",
    "best_nodes": """SELECT sample_id, concept_id AS key, confidence AS value, node_id AS id FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, concept_id ORDER BY confidence DESC, pos) AS d FROM nodes) WHERE d = 1""",
    "best_edges": "SELECT sample_id, source_concept_id || '→' || target_concept_id || ':' || edge_type AS key, max(weight) AS value FROM real_edges WHERE source_concept_id <> target_concept_id GROUP BY 1, 2",
    "marks": "SELECT sample_id, 'node' AS kind, key FROM best_nodes UNION ALL SELECT sample_id, 'edge', key FROM best_edges",
    "targets": """SELECT c.participant_id, c.concept_id, e.target_concept_id AS target_id, count(e.sample_id) AS n_any, count(*) FILTER (e.edge_type IN ('decreases', 'reduces', 'relieves')) AS n_relief
        FROM coping c LEFT JOIN real_edges e ON e.participant_id = c.participant_id AND e.source_concept_id = c.concept_id AND e.target_concept_id <> e.source_concept_id GROUP BY 1, 2, 3""",
}


def j(body: str, **extra: str) -> str:
    return sql(body, **JOURNAL, **extra)


ORACLE = {
    "classify_problem_coping": j("SELECT participant_id, concept_id, problem, coping FROM meta"),
    "first_seen_meta": j("SELECT participant_id, concept_id, type, label, polarity FROM meta"),
    "concept_days": j(f"SELECT participant_id, concept_id, days, {day('first_date')} AS first_date, {day('last_date')} AS last_date FROM cdays"),
    "mood_per_date": j(f"SELECT participant_id, {day('entry_date')} AS entry_date, {r6('mood')} AS mood FROM moods"),
    "mood_series": j(f"SELECT participant_id, entry_no, {day('entry_date')} AS entry_date, {r6('mood_score')} AS mood_score FROM numbered"),
    "mood_overview": j(f"""SELECT participant_id, n_moods, {r6('mean')} AS mean, {r6('sd')} AS sd, {r6('first_mood')} AS first_mood, {r6('last_mood')} AS last_mood, {day('best_date')} AS best_date,
        {r6('best_mood')} AS best_mood, {day('worst_date')} AS worst_date, {r6('worst_mood')} AS worst_mood, {r6('last_mood - first_mood')} AS net,
        CASE WHEN last_mood - first_mood > 0.5::DOUBLE THEN 'up' WHEN last_mood - first_mood < -0.5::DOUBLE THEN 'down' ELSE 'flat' END AS direction,
        CASE WHEN sd < 0.8::DOUBLE THEN 'low' WHEN sd < 1.6::DOUBLE THEN 'moderate' ELSE 'high' END AS volatility FROM (
        SELECT participant_id, count(*) AS n_moods, avg(mood) AS mean, stddev_pop(mood) AS sd, arg_min(mood, entry_date) AS first_mood, arg_max(mood, entry_date) AS last_mood,
        arg_max(entry_date, (mood, -date_diff('day', DATE '1970-01-01', entry_date))) AS best_date, max(mood) AS best_mood, arg_min(entry_date, (mood, entry_date)) AS worst_date, min(mood) AS worst_mood
        FROM moods GROUP BY 1 HAVING count(*) >= 2)"""),
    "journal_span": j(f"""SELECT participant_id, entries, total_days, {day('first_date')} AS first_date, {day('last_date')} AS last_date, span_days, gap_days,
        (SELECT {day('min(previous)')} FROM jdays d WHERE d.participant_id = s.participant_id AND s.gap_days > 0 AND date_diff('day', d.previous, d.entry_date) = s.gap_days + 1) AS gap_after FROM span s"""),
    "recurring_problems": j(f"""SELECT participant_id, concept_id, days, {day('first_date')} AS first_date, {day('last_date')} AS last_date, type, label, polarity, total_days, threshold, rank FROM recurring WHERE rank <= 8"""),
    "half_trend": j("""SELECT participant_id, concept_id, days, total_days, first_days, second_days, CASE WHEN second_days > first_days THEN 'increasing' WHEN second_days < first_days THEN 'decreasing' ELSE 'stable' END AS trend
        FROM halves WHERE rank <= 8"""),
    "cooccurring_concepts": j("""SELECT * FROM (SELECT participant_id, concept_id, other_id, days, row_number() OVER (PARTITION BY participant_id, concept_id ORDER BY days DESC, other_id) AS rank FROM (
        SELECT a.participant_id, a.concept_id, b.concept_id AS other_id, count(*) AS days FROM cdates a JOIN recurring r ON r.participant_id = a.participant_id AND r.concept_id = a.concept_id AND r.rank <= 8
        JOIN cdates b ON b.participant_id = a.participant_id AND b.entry_date = a.entry_date AND b.concept_id <> a.concept_id GROUP BY 1, 2, 3) WHERE days >= 2) WHERE rank <= 5"""),
    "never_with_coping": j("SELECT participant_id, concept_id, days FROM never"),
    "two_hop_chains": j("SELECT * FROM chains"),
    "recurring_chains": j("SELECT participant_id, a, b, c, days, relation_1, relation_2, rank FROM top_chains"),
    "coping_mood_delta": j(f"""SELECT participant_id, concept_id, days, n, {r6('mood_with')} AS mood_with, {r6('baseline')} AS baseline, {r6('mood_with - baseline')} AS delta,
        CASE WHEN mood_with IS NULL THEN 'not enough data' WHEN abs(mood_with - baseline) < 0.3::DOUBLE THEN 'no association' ELSE 'association' END AS verdict FROM (
        SELECT c.participant_id, c.concept_id, c.days, count(m.mood) AS n, CASE WHEN count(m.mood) >= 2 AND max(b.baseline) IS NOT NULL THEN avg(m.mood) END AS mood_with, max(b.baseline) AS baseline
        FROM coping c JOIN cdates d USING (participant_id, concept_id) LEFT JOIN moods m ON m.participant_id = c.participant_id AND m.entry_date = d.entry_date
        LEFT JOIN baseline b ON b.participant_id = c.participant_id GROUP BY 1, 2, 3)"""),
    "next_day_mood": j(f"SELECT participant_id, {day('entry_date')} AS entry_date, {r6('mood')} AS mood, {r6('next_mood')} AS next_mood, {r6('shift')} AS shift FROM next_day"),
    "coping_next_day": j(f"""SELECT c.participant_id, c.concept_id, {r6('avg(n.shift)')} AS mean_shift, count(*) AS n FROM coping c JOIN cdates d USING (participant_id, concept_id)
        JOIN next_day n ON n.participant_id = c.participant_id AND n.entry_date = d.entry_date GROUP BY 1, 2 HAVING count(*) >= 2"""),
    "coping_targets": j(f"""SELECT * FROM (SELECT participant_id, concept_id, kind, target_id, {big('n')} AS n, row_number() OVER (PARTITION BY participant_id, concept_id ORDER BY n DESC, target_id) AS rank FROM (
        SELECT participant_id, concept_id, CASE WHEN target_id IS NULL THEN 'none' WHEN relief > 0 THEN 'relief' ELSE 'any' END AS kind, coalesce(target_id, '') AS target_id,
        CASE WHEN relief > 0 THEN n_relief ELSE n_any END AS n FROM (SELECT *, sum(n_relief) OVER (PARTITION BY participant_id, concept_id) AS relief FROM targets)) WHERE n > 0 OR kind = 'none') WHERE rank <= 5"""),
    "weekday_low_mood": j(f"SELECT participant_id, weekday, {r6('mean')} AS mean, n, {r6('baseline')} AS baseline FROM low_mood"),
    "weekday_stressor_cluster": j("SELECT participant_id, weekday, n, total FROM clusters"),
    "weekday_name": j(f"SELECT sample_id, {day('entry_date')} AS entry_date, strftime(entry_date, '%A') AS weekday FROM entries"),
    "discussion_points": j("SELECT participant_id, rank, key, strength, text FROM points"),
    "day_reference": j(f"SELECT participant_id, sample_id, {day('entry_date')} AS entry_date, {r6('mood_score')} AS mood_score, top_concepts FROM dayref"),
    "day_normalise": j(f"SELECT sample_id, key, {r6('value')} AS value, id, 'node' AS kind FROM best_nodes UNION ALL SELECT sample_id, key, {r6('value')}, '', 'edge' FROM best_edges"),
    "day_diff": j(f"""SELECT n.sample_id, n.participant_id, n.entry_no, p.sample_id IS NULL AS first_day,
        CASE WHEN p.sample_id IS NULL THEN 0 ELSE (SELECT count(*) FROM marks a WHERE a.sample_id = n.sample_id AND kind = 'node' AND key NOT IN (SELECT key FROM marks b WHERE b.sample_id = p.sample_id AND b.kind = 'node')) END AS added,
        CASE WHEN p.sample_id IS NULL THEN 0 ELSE (SELECT count(*) FROM marks a WHERE a.sample_id = n.sample_id AND kind = 'node' AND key IN (SELECT key FROM marks b WHERE b.sample_id = p.sample_id AND b.kind = 'node')) END AS recurring,
        CASE WHEN p.sample_id IS NULL THEN 0 ELSE (SELECT count(*) FROM marks a WHERE a.sample_id = p.sample_id AND kind = 'node' AND key NOT IN (SELECT key FROM marks b WHERE b.sample_id = n.sample_id AND b.kind = 'node')) END AS removed,
        CASE WHEN p.sample_id IS NULL THEN 0 ELSE (SELECT count(*) FROM marks a WHERE a.sample_id = n.sample_id AND kind = 'edge' AND key NOT IN (SELECT key FROM marks b WHERE b.sample_id = p.sample_id AND b.kind = 'edge')) END AS new_edges
        FROM numbered n LEFT JOIN numbered p ON p.participant_id = n.participant_id AND p.entry_no = n.entry_no - 1 AND p.eligible WHERE n.eligible"""),
    "concept_streaks": j("""SELECT sample_id, concept_id, least(61, entry_no - min(entry_no) OVER (PARTITION BY participant_id, concept_id, island) + 1) AS streak FROM (
        SELECT *, entry_no - row_number() OVER (PARTITION BY participant_id, concept_id ORDER BY entry_no) AS island FROM (
        SELECT DISTINCT n.sample_id, n.participant_id, n.concept_id, e.entry_no FROM nodes n JOIN numbered e ON e.sample_id = n.sample_id WHERE e.eligible))"""),
    "previous_day_context": j("""SELECT n.sample_id, coalesce(f.fut, FALSE) AS had_future, coalesce(f.cop, FALSE) AS had_coping, coalesce(p.mood_score < 4.5::DOUBLE, FALSE) AS low_mood
        FROM numbered n LEFT JOIN numbered p ON p.participant_id = n.participant_id AND p.entry_no = n.entry_no - 1
        LEFT JOIN (SELECT sample_id, bool_or(temporal_status = 'future') AS fut, bool_or(type = 'coping_action') AS cop FROM nodes GROUP BY 1) f ON f.sample_id = p.sample_id"""),
}
