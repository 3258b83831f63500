"""Operators on diary texts and notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daygraph import constants as C
from daygraph.functions import text as X
from daygraph.functions.columns import count_if, ratio, rows

#: Longest start of a label that positions of a text are joined on.
HEAD = 4
#: Characters of a text that are gone through together.
PIECE = 1024


#: Labels up to which every text tries each of them in its own row: for 21 labels 4 seconds instead of 35 over sf0.1. Both ways give the same rows.
INLINE_LEXICON = 2000


def lexicon_match(texts: DataFrame, lexicon: DataFrame, inline_limit: int = INLINE_LEXICON) -> DataFrame:
    """``sample_id, concept_id`` where the lower-case label occurs in the lower-case text.

    The lexicon's size is checked first; a small one is tried inside the row. Beyond that labels fall into
    classes by length (1, 2, 3, and 4 or more letters), each with its start of that many letters as join key, so
    a short label makes no other label's key shorter. A piece of text gives its different starts for the classes
    there are; where one meets, the label is looked for. An empty label is in every text.
    """
    surface = lexicon.select("concept_id", F.lower("label").alias("surface"))
    if surface.limit(inline_limit + 1).count() <= inline_limit:
        words = surface.agg(F.collect_list(F.struct("concept_id", "surface"))).scalar()
        whole = texts.select("sample_id", F.lower("text").alias("low"), words.alias("words"))
        hits = F.filter("words", lambda w: F.contains(F.col("low"), w["surface"]))
        return whole.select("sample_id", F.explode(hits).alias("w")).select("sample_id", "w.concept_id")
    named = surface.where("surface <> ''").withColumn("class", F.least(F.length("surface"), F.lit(HEAD))).withColumn(
        "head", F.expr("substring(surface, 1, class)"))
    longest = surface.agg(F.coalesce(F.max(F.length("surface")), F.lit(0))).scalar()
    low = texts.select("sample_id", F.lower("text").alias("low")).where("low <> ''")
    pieces = low.select("sample_id", "low", F.explode(F.sequence(F.lit(0), F.floor((F.length("low") - 1) / PIECE).cast("int"))).alias("piece"), longest.alias("longest")).select(
        "sample_id", F.expr(f"substring(low, piece * {PIECE} + 1, {PIECE} + longest)").alias("part"))  # long texts are not walked from their start for every position
    classes = F.broadcast(named.select("class").distinct())  # at most HEAD rows
    starts = F.expr(f"array_distinct(transform(sequence(1, least(length(part), {PIECE})), i -> substring(part, i, class)))")
    heads = pieces.join(classes, F.col("class") <= F.length("part")).select("sample_id", "part", "class", F.explode(starts).alias("head"))
    found = heads.join(named, ["class", "head"]).where(F.contains("part", "surface"))
    empty = texts.where("text IS NOT NULL").select("sample_id").join(surface.where("surface = ''").select("concept_id"))
    return found.select("sample_id", "concept_id").distinct().unionByName(empty.distinct())


def style_length_stats(texts: DataFrame) -> DataFrame:
    """Share of texts whose word count lies in the range of their style."""
    bounds = F.create_map(*[x for k, (lo, hi) in C.STYLE_WORDS.items() for x in (F.lit(k), F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi")))])
    other = F.struct(F.lit(C.OTHER_STYLE_WORDS[0]).alias("lo"), F.lit(C.OTHER_STYLE_WORDS[1]).alias("hi"))
    counted = texts.withColumn("words", X.word_count(F.col("text"))).withColumn("b", F.coalesce(F.try_element_at(bounds, F.col("writing_style")), other))
    german = F.col("language") == "de"
    lo = F.when(german, F.greatest(F.col("b.lo"), F.lit(C.GERMAN_WORDS[0]))).otherwise(F.col("b.lo"))
    hi = F.when(german, F.least(F.col("b.hi"), F.lit(C.GERMAN_WORDS[1]))).otherwise(F.col("b.hi"))
    inside = F.col("words").between(lo, hi)
    return counted.groupBy("writing_style", "language").agg(
        rows().alias("n"), count_if(inside).alias("within"), ratio(count_if(inside), rows(), 0.0).alias("share"), F.min("words").alias("min_words"), F.max("words").alias("max_words"))


def rewrite_signs(text: Column, low: Column, language: Column) -> Column:
    """What of ``needs_rewrite`` the text alone says: a banned phrase, a German tomorrow."""
    return F.struct((F.size(X.banned(low, language)) > 0).alias("banned"), ((language == "de") & X.german_tomorrow(text)).alias("tomorrow"))


def needs_rewrite(signs: Column, offsets: Column) -> Column:
    """A banned phrase, or a German text that says tomorrow without a future node."""
    return signs["banned"] | (signs["tomorrow"] & ~F.array_contains(offsets, 1))


def note_fields(notes: DataFrame) -> DataFrame:
    """Front block, body, mood and date of raw notes (``path, raw, file_date``)."""
    fields = X.front_fields(F.col("raw"))
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.md$", "")
    parsed = notes.withColumn("fields", fields).withColumn("body", X.front_body(F.col("raw"))).withColumn("name", name)
    front = X.parse_date(F.try_element_at(F.col("fields"), F.lit("date")))
    from_name = X.parse_date(F.col("name"))
    return parsed.withColumn("mood", X.mood_alias(F.col("fields"))).withColumn(
        "date", F.coalesce(front, from_name, F.date_format("file_date", "yyyy-MM-dd"))).withColumn(
        "date_source", F.when(front.isNotNull(), "frontmatter").when(from_name.isNotNull(), "filename").otherwise("ctime"))


def ngrams(texts: DataFrame) -> DataFrame:
    """Term counts per example: words and neighbouring word pairs."""
    words = texts.select("sample_id", X.tokens(F.col("text")).alias("w"))
    pairs = F.transform(
        F.when(F.size("w") > 1, F.sequence(F.lit(1), F.size("w") - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.concat_ws(" ", F.element_at("w", i), F.element_at("w", i + 1)))
    return words.select("sample_id", F.explode(F.concat("w", pairs)).alias("term")).groupBy("sample_id", "term").agg(rows().alias("tf"))


def tfidf_vocabulary(counts: DataFrame, n_docs: Column, min_df: int = 2, max_share: float = 0.95) -> DataFrame:
    """Terms with document frequency inside the limits and their smoothed idf."""
    df = counts.groupBy("term").agg(rows().alias("df"))
    idf = F.ln((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0
    return df.where((F.col("df") >= min_df) & (F.col("df") <= n_docs * F.lit(max_share))).select("term", "df", idf.alias("idf"))


def tfidf_weights(counts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Sublinear tf-idf with unit length per example."""
    raw = counts.join(vocabulary.select("term", "idf"), "term").withColumn("w", (F.ln("tf") + 1.0) * F.col("idf"))
    norm = raw.groupBy("sample_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, "sample_id").select("sample_id", "term", (F.col("w") / F.col("norm")).alias("weight"))


def pair_features(pairs: DataFrame, with_concepts: bool = True) -> DataFrame:
    """Indicator features of a pair: types, polarities, concepts and their sorted pairs, in long form."""
    names = [("type", "type"), ("pol", "polarity")] + ([("cid", "concept_id")] if with_concepts else [])
    feats = []
    for short, col in names:
        a, b = F.col(f"{col}_a"), F.col(f"{col}_b")
        feats += [F.concat(F.lit(f"{short}_a="), a), F.concat(F.lit(f"{short}_b="), b),
                  F.concat(F.lit(f"{short}_pair="), F.concat_ws("__", F.least(a, b), F.greatest(a, b)))]
    return pairs.withColumn("features", F.array(*feats))


def string_match_predictions(texts: DataFrame, labels: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Gold and predicted label rows of the no-training floor (rows with neither are left out)."""
    hits = lexicon_match(texts, lexicon).select("sample_id", "concept_id", F.lit(1).alias("pred"))
    gold = labels.select("sample_id", "concept_id", F.lit(1).alias("gold"))
    return gold.join(hits, ["sample_id", "concept_id"], "full").fillna(0, ["gold", "pred"])
