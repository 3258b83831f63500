"""SQL for the text queries."""

import re

from daygraph import constants as C
from daygraph.functions.text import MARKDOWN_STEPS
from daygraph.oracle.base import big, r6, sql
from daygraph.oracle.evaluate import EVAL, metrics
from daygraph.oracle.verify import W
from daygraph.plans.text_queries import NOTE_END, NOTE_TOP

L = C.GERMAN_LETTERS


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def esc(s: str) -> str:
    return " || chr(10) || ".join(" || chr(9) || ".join(q(p) for p in line.split("\t")) for line in s.split("\n"))


def clean(e: str) -> str:
    for pattern, repl in MARKDOWN_STEPS:
        repl_sql = esc(repl) if "\n" in repl else q(repl.replace("$1", "\\1").replace("$2", "\\2"))
        e = f"regexp_replace({e}, {q(pattern)}, {repl_sql}, 'g')"
    return f"regexp_replace({e}, '^\\s+|\\s+\\z', '', 'g')"


def banned_list(phrases, before, after) -> str:
    return "concat_ws(', ', " + ", ".join(
        f"CASE WHEN regexp_matches(low, {q('(^|[^' + before + '])' + re.escape(p).replace(chr(92) + ' ', ' ') + after)}) THEN {q(p)} END" for p in phrases) + ")"


EN = banned_list(C.BANNED_EN, "a-z", "([^a-z]|$)")
DE = (banned_list(C.BANNED_DE, L, f"([^{L}]|$)")[:-1] + ", " + banned_list(C.BANNED_STEMS_DE, L, "")[len("concat_ws(', ', "):])


def attempt(v: str, pattern: str, y: int, m: int, d: int) -> str:
    part = lambda i: f"regexp_extract({v}, {q(pattern)}, {i})"
    dt = f"try_strptime({part(y)} || '-' || lpad({part(m)}, 2, '0') || '-' || lpad({part(d)}, 2, '0'), '%Y-%m-%d')"
    return f"CASE WHEN regexp_matches({v}, {q(pattern)}) AND year({dt}) BETWEEN 1900 AND 2100 THEN strftime({dt}, '%Y-%m-%d') END"


def parse_date(v: str) -> str:
    return ("coalesce(" + attempt(v, r"(\d{4})[-_./](\d{1,2})[-_./](\d{1,2})", 1, 2, 3) + ", " + attempt(v, r"(\d{1,2})[-./](\d{1,2})[-./](\d{4})", 3, 2, 1) + ", "
            + attempt(v, r"(?:^|\D)(\d{4})(\d{2})(\d{2})(?:\D|$)", 1, 2, 3) + ")")


FRONT = r"\A---\n([\s\S]*?)\n---\s*\n?([\s\S]*)\z"


def field(key: str) -> str:
    return f"list_extract(list_filter(kv, lambda x: x.k = '{key}'), -1).v"


def number(key: str) -> str:
    v = field(key)
    return f"CASE WHEN {v} = '' THEN 0.0 WHEN regexp_full_match({v}, '[+-]?(\\d+(\\.\\d*)?|\\.\\d+)([eE][+-]?\\d+)?') THEN try_cast({v} AS DOUBLE) END"


TEXT = {
    **EVAL,
    "lowtexts": "SELECT *, lower(text) AS low FROM texts",
    "offs": "SELECT sample_id, bool_or(day_offset = 1) AS future FROM nodes GROUP BY 1",
    "notes": f"""SELECT s.sample_id, s.entry_date, CASE WHEN s.day_index % 5 <> 0 THEN '---' || chr(10) || CASE WHEN s.day_index % 3 = 1 THEN 'date: ' || strftime(s.entry_date, '%Y/%m/%d') || ' evening' || chr(10)
        WHEN s.day_index % 3 = 2 THEN {esc(chr(10).join(['date: 2026-02-30', 'title no colon', ': empty', '']))} ELSE '' END || CASE s.user_id % 4 WHEN 0 THEN 'mood_score: ' || coalesce(s.mood_score::VARCHAR, 'n/a')
        WHEN 1 THEN 'mood: ' || coalesce(s.mood_score::VARCHAR, 'n/a') WHEN 2 THEN 'mood: none' || chr(10) || 'rating: ' || coalesce(s.mood_score::VARCHAR, 'n/a') ELSE 'mood_score:' END || chr(10) || '---' || chr(10) ELSE '' END
        || {esc(NOTE_TOP)} || t.text || {esc(NOTE_END)} AS raw,
        CASE (s.user_id + s.day_index) % 4 WHEN 0 THEN 'daily-' || strftime(s.entry_date, '%Y-%m-%d') WHEN 1 THEN strftime(s.entry_date, '%d.%m.%Y') || ' notes' WHEN 2 THEN 'd' || strftime(s.entry_date, '%Y%m%d') || 'x'
        ELSE 'quick note ' || s.day_index END AS name FROM samples s JOIN texts t ON t.sample_id = s.sample_id""",
    "parsed0": f"""SELECT *, regexp_matches(raw, {q(FRONT)}) AS front, CASE WHEN regexp_matches(raw, {q(FRONT)}) THEN regexp_replace(regexp_extract(raw, {q(FRONT)}, 2), '^\\s+|\\s+\\z', '', 'g') ELSE raw END AS body FROM notes""",
    "parsed": f"""SELECT *, list_filter(list_transform(list_filter(CASE WHEN front THEN string_split(regexp_extract(raw, {q(FRONT)}, 1), chr(10)) ELSE [] END, lambda l: instr(l, ':') > 0),
        lambda l: {{'k': trim(substr(l, 1, instr(l, ':') - 1)), 'v': trim(substr(l, instr(l, ':') + 1))}}), lambda x: x.k <> '') AS kv FROM parsed0""",
    "lex": "SELECT t.sample_id, c.concept_id FROM lowtexts t JOIN concepts c ON instr(t.low, lower(c.label)) > 0",
    "flo": """SELECT coalesce(g.sample_id, p.sample_id) AS sample_id, coalesce(g.concept_id, p.concept_id) AS concept_id, CASE WHEN g.sample_id IS NULL THEN 0 ELSE 1 END AS gold, CASE WHEN p.sample_id IS NULL THEN 0 ELSE 1 END AS score
        FROM (SELECT * FROM lab WHERE split = 'test') g FULL JOIN (SELECT * FROM lex WHERE sample_id IN (SELECT sample_id FROM ks WHERE split = 'test')) p ON p.sample_id = g.sample_id AND p.concept_id = g.concept_id""",
    "flol": "SELECT f.*, s.language FROM flo f JOIN samples s ON s.sample_id = f.sample_id",
    "toks": f"SELECT t.sample_id, regexp_extract_all(strip_accents(lower(t.text)), '[{W}]{{2,}}') AS w FROM texts t JOIN ks k ON k.sample_id = t.sample_id WHERE k.split = 'train'",
    "grams": """SELECT sample_id, term, count(*) AS tf FROM (SELECT sample_id, unnest(w) AS term FROM toks UNION ALL
        SELECT sample_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM toks) GROUP BY 1, 2""",
    "ntrain": "SELECT count(*) AS n FROM ks WHERE split = 'train'",
    "tvoc": "SELECT term, df, ln((1.0::DOUBLE + n) / (1.0::DOUBLE + df)) + 1.0 AS idf FROM (SELECT term, count(*) AS df FROM grams GROUP BY 1), ntrain WHERE df >= 2 AND df <= n * 0.95::DOUBLE",
    "tw": "SELECT g.sample_id, g.term, (ln(g.tf) + 1.0) * v.idf AS w FROM grams g JOIN tvoc v ON v.term = g.term",
}


def t(body: str, **extra: str) -> str:
    return sql(body, **TEXT, **extra)


FLOOR_COUNTS = "count(*) FILTER (gold = 1 AND score = 1) AS tp, count(*) FILTER (gold = 0 AND score = 1) AS fp, count(*) FILTER (gold = 1 AND score = 0) AS fn FROM flol"
RAW = """SELECT sample_id, CASE user_id % 5 WHEN 0 THEN body WHEN 1 THEN '```json' || chr(10) || body || chr(10) || '```' WHEN 2 THEN 'Here it is: ' || body || ' - done' WHEN 3 THEN 'no object here' ELSE '{' || body || ']' END AS raw
    FROM (SELECT *, '{"overall": "ok", "mentioned": ' || CASE WHEN day_index % 2 = 0 THEN 'true' ELSE '"true"' END || ', "n": ' || n_nodes || '}' AS body FROM samples)"""
STYLE = " ".join(f"WHEN '{k}' THEN {{i}}" for k in C.STYLE_WORDS)
LO = "CASE writing_style " + " ".join(f"WHEN '{k}' THEN {lo}" for k, (lo, hi) in C.STYLE_WORDS.items()) + " ELSE 90 END"
HI = "CASE writing_style " + " ".join(f"WHEN '{k}' THEN {hi}" for k, (lo, hi) in C.STYLE_WORDS.items()) + " ELSE 170 END"
WORDS = "len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''))"


def suffix(n: str, m: str) -> str:
    return f"'[{m}] ' || {n}.label || ' (' || {n}.type || ', ' || {n}.polarity || ', ' || {n}.anchor || ') [/{m}]'"


def feats() -> str:
    out = []
    for short, col in (("type", "type"), ("pol", "polarity"), ("cid", "concept_id")):
        out += [f"'{short}_a=' || a.{col}", f"'{short}_b=' || b.{col}", f"'{short}_pair=' || least(a.{col}, b.{col}) || '__' || greatest(a.{col}, b.{col})"]
    return "[" + ", ".join(out) + "]"


ORACLE = {
    "banned_phrases_en": t(f"SELECT * FROM (SELECT sample_id, {EN} AS phrases FROM lowtexts WHERE language <> 'de') WHERE phrases <> ''"),
    "banned_phrases_de": t(f"SELECT * FROM (SELECT sample_id, {DE} AS phrases FROM lowtexts WHERE language = 'de') WHERE phrases <> ''"),
    "needs_rewrite": t(f"""SELECT x.sample_id, (CASE WHEN language = 'de' THEN {DE} ELSE {EN} END) <> '' OR (language = 'de' AND regexp_matches(text, '(^|[^{W}])morgen([^{W}]|$)') AND NOT o.future) AS rewrite
        FROM lowtexts x JOIN offs o ON o.sample_id = x.sample_id"""),
    "word_counts": t(f"SELECT sample_id, {WORDS} AS words FROM texts"),
    "style_length_stats": t(f"""SELECT writing_style, language, count(*) AS n, {big('count(*) FILTER (words BETWEEN lo AND hi)')} AS within, {r6('count(*) FILTER (words BETWEEN lo AND hi)::DOUBLE / count(*)')} AS share,
        min(words) AS min_words, max(words) AS max_words FROM (SELECT writing_style, language, {WORDS} AS words, CASE WHEN language = 'de' THEN greatest({LO}, 80) ELSE {LO} END AS lo,
        CASE WHEN language = 'de' THEN least({HI}, 160) ELSE {HI} END AS hi FROM texts) GROUP BY 1, 2"""),
    "markdown_clean": t(f"SELECT sample_id, {clean('body')} AS clean FROM parsed"),
    "frontmatter_split": t("""SELECT sample_id, CASE WHEN front THEN array_to_string(list_sort(list_transform(list_filter(kv, lambda x, i: len(list_filter(kv[i + 1:], lambda y: y.k = x.k)) = 0), lambda x: x.k || '=' || x.v)), '; ') ELSE 'none' END AS fields,
        length(body) AS body_length FROM parsed"""),
    "mood_alias": t(f"SELECT sample_id, {r6(f'coalesce({number('mood_score')}, {number('mood')}, {number('rating')})')} AS mood FROM parsed"),
    "parse_date": t(f"SELECT sample_id, name, {parse_date('name')} AS date FROM parsed"),
    "resolve_note_date": t(f"""SELECT sample_id, coalesce(a, b, strftime(entry_date, '%Y-%m-%d')) AS date, CASE WHEN a IS NOT NULL THEN 'frontmatter' WHEN b IS NOT NULL THEN 'filename' ELSE 'ctime' END AS date_source FROM (
        SELECT sample_id, entry_date, {parse_date('fd')} AS a, {parse_date('name')} AS b FROM (SELECT *, {field('date')} AS fd FROM parsed))"""),
    "filter_min_text": t(f"SELECT participant_id, {big(f'count(*) FILTER (length({clean('text')}) >= 15)')} AS kept, {big(f'count(*) FILTER (length({clean('text')}) < 15)')} AS skipped FROM texts GROUP BY 1"),
    "json_lenient": t("""SELECT sample_id, CASE WHEN obj IS NULL THEN 'no JSON object found' WHEN NOT json_valid(obj) THEN 'invalid JSON' ELSE '' END AS error,
        coalesce(CASE WHEN obj IS NOT NULL AND json_valid(obj) THEN json_type(obj, '$.mentioned') = 'BOOLEAN' AND json_extract_string(obj, '$.mentioned') = 'true' END, FALSE) AS mentioned,
        CASE WHEN json_valid(obj) THEN CAST(json_extract_string(obj, '$.n') AS BIGINT) END AS n FROM (
        SELECT sample_id, CASE WHEN instr(inside, '{') > 0 AND instr(inside, '}') > 0 THEN substr(inside, instr(inside, '{'), length(inside) - instr(reverse(inside), '}') + 1 - instr(inside, '{') + 1) END AS obj FROM (
        SELECT sample_id, CASE WHEN raw LIKE '```%' THEN regexp_replace(string_split(raw, '```')[2], '^json', '') ELSE raw END AS inside FROM rawv))""", rawv=RAW),
    "anchor_to_date": t(f"SELECT sample_id, node_id, anchor, {big('day_offset')} AS day_offset, temporal_status AS status, strftime(entry_date + CAST(day_offset AS INTEGER), '%Y-%m-%d') AS date FROM nodes"),
    "pair_text": t(f"SELECT x.example_id, {suffix('a', 'N1')} || ' ' || {suffix('b', 'N2')} AS suffix FROM rex x JOIN nodes a ON a.sample_id = x.sample_id AND a.node_id = x.node_a JOIN nodes b ON b.sample_id = x.sample_id AND b.node_id = x.node_b"),
    "lexicon_match": t("SELECT sample_id, concept_id FROM lex"),
    "string_match_floor": t(f"SELECT language, {metrics('(SELECT count(*) FROM concepts)')} FROM (SELECT language, concept_id, {FLOOR_COUNTS} GROUP BY 1, 2 UNION ALL SELECT 'all', concept_id, {FLOOR_COUNTS} GROUP BY 1, 2) GROUP BY 1"),
    "tfidf_vocabulary": t(f"SELECT term, df, {r6('idf')} AS idf FROM tvoc"),
    "tfidf_terms": t(f"SELECT sample_id, term, {r6('w / sqrt(sum(w * w) OVER (PARTITION BY sample_id))')} AS weight FROM tw"),
    "pair_features": t(f"SELECT x.example_id, unnest({feats()}) AS feature FROM rex x JOIN nodes a ON a.sample_id = x.sample_id AND a.node_id = x.node_a JOIN nodes b ON b.sample_id = x.sample_id AND b.node_id = x.node_b"),
}
