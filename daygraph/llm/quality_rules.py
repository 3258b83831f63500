"""Quality rules with host verdicts, on built-in functions only.

Every document is measured once (words, symbols, repeated lines and 5-word
windows) and the measures, without the text, are written to the shared folder.
Rule failures are summed per host (map-side, so a hot host is a handful of
partial rows), the failure rates are shrunk by a beta prior fitted to all hosts,
and the verdict of a host goes back to its documents:

* a host whose shrunk rate of base failures reaches ``HOST_LIMIT`` is rejected whole;
* where the shrunk rate of a soft rule reaches both ``SUSPECT_RATE`` and
  ``SUSPECT_RATIO`` times the mean of all hosts, documents of the host that
  break this rule are rejected; elsewhere a broken soft rule alone rejects nothing.

Defined results: a null text is an empty text (fails: too few words); a null host
is a host of its own; repeated rows and repeated ids are judged row by row; an
empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daygraph.llm import words as W
from daygraph.llm.places import placed
from daygraph.session import discard, written

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PCT = 20
SYMBOLS = "#*$%&|<>"
#: Failed documents per host from which the whole host is rejected.
HOST_LIMIT = 0.5
#: A soft rule counts on hosts at or above this rate and this multiple of the mean rate.
SUSPECT_RATE, SUSPECT_RATIO = 0.2, 1.5
#: Bounds of the prior's strength (alpha + beta), for hosts that all agree or all differ.
MIN_STRENGTH, MAX_STRENGTH = 2.0, 1000.0
SOFT = ("symbols", "dup_lines", "word_length")
RULES = ("base", *SOFT)


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: F.trim(line, F.lit(W.BLANKS)) != "")


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` and ``n_lines`` as ``q_``-columns.

    Windows are compared as 64-bit hashes within one text. Only texts in which a
    hash occurs twice sort their windows; the sorted neighbours give the repeated
    places, and the covered words are the union of their 5-word intervals.
    """
    step = (
        df.withColumn("q_text", W.text_of(text))
        .withColumn("q_words", W.blank_words(F.col("q_text")))
        .withColumn("q_lines", _lines(F.col("q_text")))
        .withColumns({
            "q_n_words": F.size("q_words").cast("long"),
            "q_word_chars": F.length(F.array_join("q_words", "")).cast("long"),
            "q_n_symbols": (F.length(F.col("q_text")) - F.length(F.regexp_replace("q_text", f"[{SYMBOLS}]+", ""))).cast("long"),
            "q_n_lines": F.size("q_lines").cast("long"),
            "q_n_dup_lines": (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long"),
            "q_hash": F.when(F.size("q_words") >= WINDOW, F.transform(
                F.sequence(F.lit(0), F.size("q_words") - WINDOW),
                lambda i: F.xxhash64(*[F.get(F.col("q_words"), i + k) for k in range(WINDOW)]))),
        })
        .drop("q_text", "q_lines", "q_words")
    )
    step = step.withColumn("q_sorted", F.when(
        F.size(F.array_distinct("q_hash")) < F.size("q_hash"),
        F.sort_array(F.transform(F.col("q_hash"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, k: F.coalesce(F.get(F.col("q_sorted"), k)["h"] == x["h"], F.lit(False))
    twice = F.filter(F.col("q_sorted"), lambda x, k: same(x, k - 1) | same(x, k + 1))
    step = step.withColumn("q_places", F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate(
        F.col("q_places"), F.struct(F.lit(0).alias("end"), F.lit(0).alias("total")),
        lambda acc, p: F.struct(
            (p + WINDOW).alias("end"), (acc["total"] + p + WINDOW - F.greatest(acc["end"], p)).alias("total")))
    return step.withColumn("q_n_repeat_words", F.coalesce(covered["total"], F.lit(0)).cast("long")).drop(
        "q_hash", "q_sorted", "q_places")


def with_failures(measured: DataFrame) -> DataFrame:
    """Adds one boolean ``q_fail_<rule>`` per rule; comparisons in whole numbers."""
    n = F.col("q_n_words")
    return measured.withColumns({
        "q_fail_base": (n < MIN_WORDS) | (100 * F.col("q_n_repeat_words") > MAX_REPEAT_PCT * n),
        "q_fail_symbols": 10 * F.col("q_n_symbols") > n,
        "q_fail_dup_lines": 10 * F.col("q_n_dup_lines") > 3 * F.col("q_n_lines"),
        "q_fail_word_length": (F.col("q_word_chars") < 2 * n) | (F.col("q_word_chars") > 12 * n),
    })


def host_verdicts(flagged: DataFrame, host: str) -> DataFrame:
    """One row per host: ``v_host``, ``v_reject`` and ``v_<soft rule>`` after shrinking by the empirical beta prior."""
    sums = flagged.groupBy(F.col(host).alias("v_host")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.col(f"q_fail_{r}").cast("long")).alias(r) for r in RULES])
    rates = sums.select("v_host", "n", F.explode(F.array(
        *[F.struct(F.lit(r).alias("rule"), F.col(r).alias("k")) for r in RULES])).alias("x")).select(
        "v_host", "n", F.col("x.rule").alias("rule"), F.col("x.k").alias("k"))
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    prior = rates.groupBy("rule").agg(
        F.sum(n).alias("sn"), F.sum(k).alias("sk"), F.sum(k * k / n).alias("skk"), F.sum(n * n).alias("snn"),
        F.count(F.lit(1)).cast("double").alias("hosts"))
    # Weighted moments: between-host variance is what the spread of rates exceeds their sampling noise by.
    mean = F.col("sk") / F.col("sn")
    noise = mean * (1 - mean)
    spread = F.col("skk") - F.col("sk") * mean
    between = (spread - (F.col("hosts") - 1) * noise) / (F.col("sn") - F.col("snn") / F.col("sn"))
    strength = F.when((F.col("hosts") > 1) & (between > 0), noise / between - 1).otherwise(F.lit(MAX_STRENGTH))
    prior = prior.select("rule", mean.alias("mean"), F.least(F.greatest(
        strength, F.lit(MIN_STRENGTH)), F.lit(MAX_STRENGTH)).alias("strength"))
    # One row per rule, four in all, whatever the input: a bounded broadcast.
    shrunk = rates.join(F.broadcast(prior), "rule").withColumn(
        "rate", (F.col("k") + F.col("mean") * F.col("strength")) / (F.col("n") + F.col("strength")))
    suspect = (F.col("rate") >= SUSPECT_RATE) & (F.col("rate") >= SUSPECT_RATIO * F.col("mean"))
    of = lambda rule, test: F.max(F.when(F.col("rule") == rule, test))
    return shrunk.groupBy("v_host").agg(
        of("base", F.col("rate") >= HOST_LIMIT).alias("v_reject"), *[of(r, suspect).alias(f"v_{r}") for r in SOFT])


def judge(flagged: DataFrame, verdicts: DataFrame, host: str) -> DataFrame:
    """Adds ``q_kept``. The join is null-safe; a hot host is split by AQE, or the small side is broadcast at run time."""
    soft = F.lit(False)
    for r in SOFT:
        soft = soft | (F.col(f"q_fail_{r}") & F.col(f"v_{r}"))
    return flagged.join(verdicts, F.col(host).eqNullSafe(F.col("v_host")), "left").withColumn(
        "q_kept", ~F.col("q_fail_base") & ~F.col("v_reject") & ~soft)


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Measures and verdict of every document: ``doc_id``, host, measures, ``base_failed``, ``kept``."""
    measured = written(with_failures(measure(docs.select(
        F.col(doc_id).alias("q_id"), F.col(host).alias("q_host"), F.col(text).alias("q_raw")), "q_raw")).drop("q_raw"), "quality")
    judged = judge(measured, host_verdicts(measured, "q_host"), "q_host")
    return judged.select(
        F.col("q_id").alias("doc_id"), F.col("q_host").alias("host"),
        *[F.col(f"q_{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        F.col("q_fail_base").alias("base_failed"), F.col("q_kept").alias("kept"))


def keep_good(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """Documents that pass, with their own columns.

    Texts are measured once; measures are written with the places of their rows, without the
    texts, and what is rejected is taken away by place. The size of that table decides the join.
    """
    rows, _ = placed(docs)
    measured = written(with_failures(measure(rows.select(
        F.col("row").alias("q_row"), F.col(f"doc.`{host}`").alias("q_host"), F.col(f"doc.`{text}`").alias("q_raw")), "q_raw")).drop("q_raw"), "quality")
    gone = written(judge(measured, host_verdicts(measured, "q_host"), "q_host").where("NOT q_kept").select(F.col("q_row").alias("row")), "rejected")
    discard(measured)
    return rows.join(gone, "row", "left_anti").select("doc.*")


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Quality measures and verdict of every document of ``documents``, its source as host."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_rules(docs).drop("host")


QUERIES = {"op1_quality_rules": op1_quality_rules}

_SQL_WINDOW = "[" + ", ".join(f"w[i + {k}]" for k in range(1, WINDOW + 1)) + "]"
ORACLE = {"op1_quality_rules": f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents),
win AS (SELECT rid, i, {_SQL_WINDOW} AS g FROM (SELECT rid, w, unnest(range(0, len(w) - {WINDOW - 1})) AS i FROM d)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest(range(0, {WINDOW})) AS k) GROUP BY rid),
m AS (
  SELECT d.rid, doc_id, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(lines) AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN cov USING (rid)),
f AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PCT} * n_words AS base, 10 * n_symbols > n_words AS symbols,
         10 * n_dup_lines > 3 * n_lines AS dup_lines, word_chars < 2 * n_words OR word_chars > 12 * n_words AS word_length FROM m),
hosts AS (
  SELECT source, rule, count(*)::DOUBLE AS n, sum(CASE WHEN failed THEN 1 ELSE 0 END)::DOUBLE AS k
  FROM (UNPIVOT (SELECT source, base, symbols, dup_lines, word_length FROM f) ON base, symbols, dup_lines, word_length INTO NAME rule VALUE failed)
  GROUP BY source, rule),
mom AS (SELECT rule, sum(n) AS sn, sum(k) AS sk, sum(k * k / n) AS skk, sum(n * n) AS snn, count(*)::DOUBLE AS h, sum(k) / sum(n) AS mean FROM hosts GROUP BY rule),
btw AS (SELECT rule, mean, h, mean * (1 - mean) AS noise, (skk - sk * mean - (h - 1) * mean * (1 - mean)) / nullif(sn - snn / sn, 0) AS b FROM mom),
prior AS (SELECT rule, mean, least(greatest(CASE WHEN h > 1 AND b > 0 THEN noise / b - 1 ELSE {MAX_STRENGTH} END, {MIN_STRENGTH}), {MAX_STRENGTH}) AS s FROM btw),
post AS (SELECT source, rule, mean, (k + mean * s) / (n + s) AS rate FROM hosts JOIN prior USING (rule)),
v AS (
  SELECT source, bool_or(rule = 'base' AND rate >= {HOST_LIMIT}) AS reject,
         {", ".join(f"bool_or(rule = '{r}' AND rate >= {SUSPECT_RATE} AND rate >= {SUSPECT_RATIO} * mean) AS v_{r}" for r in SOFT)}
  FROM post GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base AS base_failed,
       NOT base AND NOT reject {"".join(f"AND NOT ({r} AND v_{r}) " for r in SOFT)} AS kept
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""}
