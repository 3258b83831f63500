"""Registered queries on texts, notes and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from daygraph import constants as C
from daygraph.functions import text as X
from daygraph.functions.columns import count_if, r6
from daygraph.operators import evaluate as E
from daygraph.operators import texts as TX
from daygraph.operators.verify import offsets
from daygraph.plans.prepare_queries import kept_samples, labels, random_examples
from daygraph.session import fresh_path
from daygraph.sources import files as S
from daygraph.sources.day_graphs import DayGraphs

NOTE_TOP = "# Heading of the day\n\n- [x] done task\n* item one\n> quote with **bold** and _it_ words\nSee [[Target|Alias]] and [[Plain]], [link](http://x.y) ![[img.png]] `code` #tag/sub end\n\n\n\n"
NOTE_END = "\n---\n```\nraw code\n```\nlast  line\t here"


def notes(t):
    """Raw notes that meet every branch of the parsers."""
    s = t.samples()
    u, d = F.col("user_id"), F.col("day_index")
    iso = F.date_format("entry_date", "yyyy-MM-dd")
    name = pick_name(u, d)
    mood = F.coalesce(F.col("mood_score").cast("string"), F.lit("n/a"))
    mood_line = (
        F.when(u % 4 == 0, F.concat(F.lit("mood_score: "), mood)).when(u % 4 == 1, F.concat(F.lit("mood: "), mood))
        .when(u % 4 == 2, F.concat(F.lit("mood: none\nrating: "), mood)).otherwise("mood_score:"))
    date_line = F.when(d % 3 == 1, F.concat(F.lit("date: "), F.date_format("entry_date", "yyyy/MM/dd"), F.lit(" evening\n"))).when(
        d % 3 == 2, F.lit("date: 2026-02-30\ntitle no colon\n: empty\n")).otherwise("")
    front = F.when(d % 5 != 0, F.concat(F.lit("---\n"), date_line, mood_line, F.lit("\n---\n"))).otherwise("")
    return t.with_texts(s).select(
        "sample_id", F.concat(F.lit("journal/"), "participant_id", F.lit("/"), name, F.lit(".md")).alias("path"), iso.alias("_iso"),
        F.concat(front, F.lit(NOTE_TOP), "text", F.lit(NOTE_END)).alias("raw"), F.col("entry_date").alias("file_date"))


def pick_name(u, d):
    fmt = lambda f: F.date_format("entry_date", f)
    return (
        F.when((u + d) % 4 == 0, F.concat(F.lit("daily-"), fmt("yyyy-MM-dd"))).when((u + d) % 4 == 1, F.concat(fmt("dd.MM.yyyy"), F.lit(" notes")))
        .when((u + d) % 4 == 2, F.concat(F.lit("d"), fmt("yyyyMMdd"), F.lit("x"))).otherwise(F.concat(F.lit("quick note "), d.cast("string"))))


def parsed(t):
    return TX.note_fields(notes(t))


def banned_phrases_en(spark, sf_dir):
    found = DayGraphs(spark, sf_dir).texts().where("language <> 'de'").withColumn("low", F.lower("text")).select("sample_id", F.array_join(X.banned_en(F.col("low")), ", ").alias("phrases"))
    return found.where("phrases <> ''")


def banned_phrases_de(spark, sf_dir):
    found = DayGraphs(spark, sf_dir).texts().where("language = 'de'").withColumn("low", F.lower("text")).select("sample_id", F.array_join(X.banned_de(F.col("low")), ", ").alias("phrases"))
    return found.where("phrases <> ''")


def needs_rewrite(spark, sf_dir):
    t = DayGraphs(spark, sf_dir)
    signs = TX.rewrite_signs(F.col("text"), F.col("low"), F.col("language")).alias("signs")
    said = t.texts().withColumn("low", F.lower("text")).select("sample_id", signs)
    return said.join(offsets(t.nodes()), "sample_id").select("sample_id", TX.needs_rewrite(F.col("signs"), F.col("offsets")).alias("rewrite"))


def word_counts(spark, sf_dir):
    return DayGraphs(spark, sf_dir).texts().select("sample_id", X.word_count(F.col("text")).alias("words"))


def style_length_stats(spark, sf_dir):
    return TX.style_length_stats(DayGraphs(spark, sf_dir).texts()).withColumn("share", r6(F.col("share")))


def markdown_clean(spark, sf_dir):
    return parsed(DayGraphs(spark, sf_dir)).select("sample_id", X.clean_markdown(F.col("body")).alias("clean"))


def frontmatter_split(spark, sf_dir):
    fields = F.array_sort(F.map_entries("fields"))
    shown = F.array_join(F.transform(fields, lambda e: F.concat_ws("=", e["key"], e["value"])), "; ")
    return parsed(DayGraphs(spark, sf_dir)).select("sample_id", F.coalesce(shown, F.lit("none")).alias("fields"), F.length("body").cast("long").alias("body_length"))


def mood_alias(spark, sf_dir):
    return parsed(DayGraphs(spark, sf_dir)).select("sample_id", r6(F.col("mood")).alias("mood"))


def parse_date(spark, sf_dir):
    """Dates found in file names."""
    return parsed(DayGraphs(spark, sf_dir)).select("sample_id", "name", X.parse_date(F.col("name")).alias("date"))


def resolve_note_date(spark, sf_dir):
    """Dates of notes read back from archives; where neither front block nor name has one, the time of the file counts."""
    vault = fresh_path(spark, "archive")
    folder = F.concat(F.lit("journal/"), "sample_id", F.lit("/"), F.element_at(F.split("path", "/"), -1)).alias("path")
    S.write_note_archive(notes(DayGraphs(spark, sf_dir)).select(folder, "raw", F.col("file_date").cast("timestamp").alias("modified")), vault)
    read = S.read_note_archive(spark, vault).withColumn("file_date", F.to_date("modified"))
    return TX.note_fields(read).select(F.split("path", "/")[1].alias("sample_id"), "date", "date_source")


def filter_min_text(spark, sf_dir):
    """Diary texts kept and skipped by cleaned length."""
    clean = F.length(X.clean_markdown(F.col("text"))) >= C.MIN_TEXT_LENGTH
    return DayGraphs(spark, sf_dir).texts().groupBy("participant_id").agg(count_if(clean).alias("kept"), count_if(~clean).alias("skipped"))


def raw_verdicts(t):
    body = F.concat(F.lit('{"overall": "ok", "mentioned": '), F.when(F.col("day_index") % 2 == 0, "true").otherwise('"true"'), F.lit(', "n": '), F.col("n_nodes").cast("string"), F.lit("}"))
    u = F.col("user_id") % 5
    raw = (
        F.when(u == 0, body).when(u == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(u == 2, F.concat(F.lit("Here it is: "), body, F.lit(" - done")))
        .when(u == 3, F.lit("no object here")).otherwise(F.concat(F.lit("{"), body, F.lit("]"))))
    return t.samples().select("sample_id", raw.alias("raw"))


def json_lenient(spark, sf_dir):
    """Object found in a raw answer, with the error where there is none."""
    body = X.outer_json(F.col("raw"))
    doc = F.from_json(body, "overall string, mentioned boolean, n int, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    bad = F.try_parse_json(body).isNull()
    out = raw_verdicts(DayGraphs(spark, sf_dir)).withColumn("d", doc).select(
        "sample_id", F.when(body.isNull(), "no JSON object found").when(bad, "invalid JSON").otherwise("").alias("error"),
        F.when(~bad & F.col("d.mentioned").isNotNull(), F.col("d.mentioned")).otherwise(False).alias("mentioned"),
        F.when(~bad, F.get_json_object(body, "$.n").cast("long")).alias("n"))
    return out


def anchor_to_date(spark, sf_dir):
    """Anchor text to offset and status through the fixed table, with the absolute date."""
    table = F.create_map(*[x for text, off, status in C.ANCHORS for x in (F.lit(text), F.struct(F.lit(off).alias("day_offset"), F.lit(status).alias("status")))])
    found = F.try_element_at(table, F.col("anchor"))
    return DayGraphs(spark, sf_dir).nodes().select(
        "sample_id", "node_id", "anchor", found["day_offset"].cast("long").alias("day_offset"), found["status"].alias("status"),
        F.date_format(F.date_add("entry_date", found["day_offset"]), "yyyy-MM-dd").alias("date"))


def pair_text(spark, sf_dir):
    """Pair suffix of every example; the entry text is joined by the consumer."""
    t = DayGraphs(spark, sf_dir)
    form = lambda marker: F.format_string(f"[{marker}] %s (%s, %s, %s) [/{marker}]", "label", "type", "polarity", F.coalesce("anchor", F.lit("unknown")))
    side = lambda s, m: t.nodes().select("sample_id", F.col("node_id").alias(f"node_{s}"), form(m).alias(f"text_{s}"))
    return random_examples(t).select("example_id", "sample_id", "node_a", "node_b").join(side("a", "N1"), ["sample_id", "node_a"]).join(
        side("b", "N2"), ["sample_id", "node_b"]).select("example_id", F.concat_ws(" ", "text_a", "text_b").alias("suffix"))


def lexicon_match(spark, sf_dir):
    t = DayGraphs(spark, sf_dir)
    return TX.lexicon_match(t.texts(), t.concepts())


def string_match_floor(spark, sf_dir):
    t = DayGraphs(spark, sf_dir)
    test = kept_samples(t).where("split = 'test'").select("sample_id")
    rowset = TX.string_match_predictions(t.texts(t.samples().join(test, "sample_id", "left_semi")), labels(t).join(test, "sample_id", "left_semi"), t.concepts())
    rowset = rowset.join(t.samples().select("sample_id", "language"), "sample_id")
    per = E.label_counts(rowset, ["language"])
    whole = per.groupBy("concept_id").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]).withColumn("language", F.lit("all"))
    vocab = t.concepts().agg(F.count(F.lit(1))).scalar()
    out = E.multilabel_metrics(per.unionByName(whole), ["language"], vocab)
    return out.withColumns({c: r6(F.col(c)) for c in out.columns if c != "language"})


def train_counts(t):
    """Term counts of the train texts, written once for vocabulary and weights, and the number of texts."""
    train = kept_samples(t).where("split = 'train'").select("sample_id")
    return t.stored("train_counts", lambda: TX.ngrams(t.texts(t.samples().join(train, "sample_id", "left_semi")))), train.agg(F.count(F.lit(1))).scalar()


def tfidf_vocabulary(spark, sf_dir):
    counts, n = train_counts(DayGraphs(spark, sf_dir))
    return TX.tfidf_vocabulary(counts, n).withColumn("idf", r6(F.col("idf")))


def tfidf_terms(spark, sf_dir):
    counts, n = train_counts(DayGraphs(spark, sf_dir))
    return TX.tfidf_weights(counts, TX.tfidf_vocabulary(counts, n)).withColumn("weight", r6(F.col("weight")))


def example_pairs(t):
    side = lambda s: t.nodes().select("sample_id", F.col("node_id").alias(f"node_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in ("type", "polarity", "concept_id")])
    return random_examples(t).select("example_id", "sample_id", "split", "node_a", "node_b", "connected").join(side("a"), ["sample_id", "node_a"]).join(side("b"), ["sample_id", "node_b"])


def pair_features(spark, sf_dir):
    return TX.pair_features(example_pairs(DayGraphs(spark, sf_dir))).select("example_id", F.explode("features").alias("feature"))


QUERIES = {f.__name__: f for f in [
    banned_phrases_en, banned_phrases_de, needs_rewrite, word_counts, style_length_stats, markdown_clean, frontmatter_split, mood_alias,
    parse_date, resolve_note_date, filter_min_text, json_lenient, anchor_to_date, pair_text, lexicon_match, string_match_floor,
    tfidf_vocabulary, tfidf_terms, pair_features,
]}
