"""SQL for the streaming queries: the batch result each stream must reach."""

from daygraph.oracle.base import big, r6, sql
from daygraph.oracle.journal import JOURNAL
from daygraph.oracle.verify import VERIFY

ALL = {**VERIFY, **JOURNAL}


def w(body: str, **extra: str) -> str:
    return sql(body, **ALL, **extra)


LATE = "EXISTS (SELECT 1 FROM fin WHERE sample_id LIKE '%0!_d%' ESCAPE '!' AND d < (SELECT max(d) FROM fin) - 13) AS late_dropped"
RATES = f"""count(*) AS n, {big("count(*) FILTER (decision = 'accept')")} AS n_accept, {big("count(*) FILTER (decision = 'review')")} AS n_review, {big("count(*) FILTER (decision = 'reject')")} AS n_reject"""
FIN = "SELECT s.sample_id, s.language, s.decision, CAST(max(e.ts) AS DATE) AS d FROM stored s JOIN nodes n ON n.sample_id = s.sample_id JOIN events e ON e.event_id = n.event_id GROUP BY 1, 2, 3"
ORACLE = {
    "stream_ingest_score": w(f"SELECT sample_id, {r6('overall_confidence')} AS overall_confidence, decision FROM stored"),
    "stream_usage_totals": w(f"""SELECT {big('sum(prompt_tokens)')} AS prompt_tokens, {big('sum(completion_tokens)')} AS completion_tokens, {big('sum(llm_calls)')} AS llm_calls, count(*) AS completed,
        {r6('sum(prompt_tokens) / 1e6 * 0.15::DOUBLE + sum(completion_tokens) / 1e6 * 0.60::DOUBLE')} AS cost_usd FROM samples"""),
    "stream_latest_note": w("""SELECT user_id AS note_id, count(*) AS edits, arg_max(props, (ts, event_id)) AS body, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_edit FROM (
        SELECT *, sum(CASE WHEN prev IS NULL OR ts - prev >= INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM (
        SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)) GROUP BY user_id, burst"""),
    "stream_decision_rates": w(f"""SELECT strftime(d, '%Y-%m-%d') AS window_start, strftime(d + 1, '%Y-%m-%d') AS window_end, language, {RATES}, 'tumbling' AS kind, {LATE} FROM fin GROUP BY d, language
        UNION ALL SELECT strftime(d - x, '%Y-%m-%d'), strftime(d - x + 2, '%Y-%m-%d'), language, {RATES}, 'sliding', {LATE} FROM fin, (VALUES (0), (1)) v(x) GROUP BY d - x, language""", fin=FIN),
    "stream_day_diff": w("""SELECT n.participant_id, n.sample_id, n.entry_no, p.sample_id IS NULL AS first_day,
        CASE WHEN p.sample_id IS NULL THEN 0 ELSE (SELECT count(*) FROM marks a WHERE a.sample_id = n.sample_id AND kind = 'node' AND key NOT IN (SELECT key FROM marks b WHERE b.sample_id = p.sample_id AND b.kind = 'node')) END AS added,
        CASE WHEN p.sample_id IS NULL THEN 0 ELSE (SELECT count(*) FROM marks a WHERE a.sample_id = n.sample_id AND kind = 'node' AND key IN (SELECT key FROM marks b WHERE b.sample_id = p.sample_id AND b.kind = 'node')) END AS recurring,
        CASE WHEN p.sample_id IS NULL THEN 0 ELSE (SELECT count(*) FROM marks a WHERE a.sample_id = p.sample_id AND kind = 'node' AND key NOT IN (SELECT key FROM marks b WHERE b.sample_id = n.sample_id AND b.kind = 'node')) END AS removed
        FROM numbered n LEFT JOIN numbered p ON p.participant_id = n.participant_id AND p.entry_no = n.entry_no - 1 AND p.eligible WHERE n.eligible"""),
}
