"""Registered queries on reading, writing, looking up and inspecting records."""

from __future__ import annotations

from pyspark.sql import functions as F

from daygraph.functions.columns import count_if, r6, rows
from daygraph.functions.ranking import range_rank
from daygraph.operators import extract as X
from daygraph.operators import graph as G
from daygraph.operators import prepare as P
from daygraph.operators.prepare import hex_number
from daygraph.plans import verify_queries as VQ
from daygraph.plans.prepare_queries import index, random_examples, splits
from daygraph.plans.text_queries import notes
from daygraph.session import fresh_path, written
from daygraph.sources import files as S
from daygraph.sources.day_graphs import DayGraphs


def scan_samples(spark, sf_dir):
    """Records written as JSON lines (with blank lines between) and read back."""
    t = DayGraphs(spark, sf_dir)
    path = fresh_path(spark, "samples")
    line = F.concat(F.to_json(F.struct("*")), F.lit("\n"))
    S.sample_records(t.samples(), t.nodes(), t.edges()).select(line.alias("value")).write.text(path)
    back = S.read_samples(spark, path)
    return back.groupBy("sample_id").agg(
        F.first("participant.participant_id").alias("participant_id"), r6(F.max("mood_score")).alias("mood_score"),
        F.sum(F.size("graph.nodes")).cast("long").alias("n_nodes"), F.sum(F.size("graph.edges")).cast("long").alias("n_edges"),
        r6(F.sum(F.aggregate("graph.edges", F.lit(0.0), lambda a, e: a + e["weight"]))).alias("weight"))


def scan_torn_tail(spark, sf_dir):
    t = DayGraphs(spark, sf_dir)
    path = fresh_path(spark, "torn")
    line = F.to_json(F.struct("sample_id", "scenario", "age"))
    torn = F.when((F.col("user_id") + F.col("day_index")) % 50 == 0, F.substring(line, F.lit(1), F.length(line) - 7)).otherwise(line)
    t.samples().select(torn.alias("value")).write.text(path)
    return S.read_torn(spark, path, "sample_id string, scenario string, age bigint")


def scan_concepts(spark, sf_dir):
    t = DayGraphs(spark, sf_dir)
    path = fresh_path(spark, "pool")
    part = F.substring(F.md5("concept_id"), 1, 3)
    pool = t.concepts().groupBy(part.alias("part")).agg(F.sort_array(F.collect_list(F.struct("concept_id", "type", "label", "polarity"))).alias("node_concepts"))
    pool.select("node_concepts").write.json(path)
    return S.read_concepts(spark, path, multi_line=False)


def scan_split_map(spark, sf_dir):
    t = DayGraphs(spark, sf_dir)
    path = fresh_path(spark, "splits")
    part = F.substring(F.md5("participant_id"), 1, 3)
    lists = splits(t).groupBy("split", part.alias("part")).agg(F.collect_list("participant_id").alias("ids"))
    lists.select(F.to_json(F.struct(F.create_map("split", "ids").alias("participants"))).alias("value")).write.text(path)
    return S.read_split_map(spark, path)


def scan_relation_map(spark, sf_dir):
    t = DayGraphs(spark, sf_dir)
    path = fresh_path(spark, "relations")
    keyed = G.relation_majority(t.nodes(), t.edges()).withColumn("key", F.concat_ws("|", "src_type", "dst_type"))
    keyed.agg(F.map_from_entries(F.collect_list(F.struct("key", "relation"))).alias("relation"),
              F.map_from_entries(F.collect_list(F.struct("key", "n"))).alias("count")).write.json(path)
    return S.read_relation_map(spark, path)


def scan_notes(spark, sf_dir):
    """Notes from archives of many notes per file, with line ends and markup as they were."""
    path = fresh_path(spark, "vault")
    note = F.concat(F.lit("journal/"), "sample_id", F.lit(".md")).alias("path")
    S.write_note_archive(notes(DayGraphs(spark, sf_dir)).select(note, "raw", F.col("file_date").cast("timestamp").alias("modified")), path)
    return S.read_note_archive(spark, path).select(F.regexp_extract("path", r"/([^/]+)\.md$", 1).alias("sample_id"), F.md5("raw").alias("digest"))


def sink_examples_by_split(spark, sf_dir):
    path = fresh_path(spark, "examples")
    S.write_by_split(random_examples(DayGraphs(spark, sf_dir)).select("example_id", "type_pair", "connected", "split"), path)
    back = spark.read.parquet(path)
    return back.groupBy("split").agg(rows().alias("n"), count_if(F.col("connected")).alias("positives"))


def sink_sorted_rewrite(spark, sf_dir):
    """Two rewrites of one dataset; the published one read back with the place of each row in the whole order."""
    path, order = fresh_path(spark, "sorted"), ["participant_id", "day_index"]
    samples = DayGraphs(spark, sf_dir).samples().select("participant_id", "day_index", "sample_id")
    S.write_sorted(samples.where("day_index = 1"), path, order)
    S.write_sorted(samples, path, order)
    return S.read_sorted(spark, path, "participant_id string, day_index int, sample_id string", order)


def sink_append(spark, sf_dir):
    """Records appended in two batches and read back; samples meet their decisions once, not per batch."""
    t = DayGraphs(spark, sf_dir)
    path = fresh_path(spark, "append")
    even = written(VQ.records(t).select("sample_id", "decision", (F.col("day_index") % 2).alias("batch")), "append-records")
    for batch in (0, 1):
        S.append_records(even.where(F.col("batch") == batch), path)
    return spark.read.schema("sample_id string, decision string, batch int").json(path).groupBy("batch", "decision").agg(rows().alias("n"))


def sink_csv_table(spark, sf_dir):
    path = fresh_path(spark, "typepairs")
    S.write_typepair_csv(P.typepair_from_examples(random_examples(DayGraphs(spark, sf_dir)), []), path)
    return spark.read.option("header", True).schema("type_pair string, n bigint, n_connected bigint, p_connected string").csv(path)


def sink_json_summary(spark, sf_dir):
    path = fresh_path(spark, "labels")
    S.write_json_summary(index(DayGraphs(spark, sf_dir)), path, "concept_id", "train_support")
    return spark.read.text(path).select(F.col("value").alias("line"))


def lookup_participant_day(spark, sf_dir):
    return DayGraphs(spark, sf_dir).samples().where("participant_id = 'p00003' AND day_index = 2").select("sample_id", "scenario", "n_nodes").limit(1)


def lookup_line_index(spark, sf_dir):
    """The 100th record (zero-based) in participant and day order."""
    placed = range_rank(DayGraphs(spark, sf_dir).samples().select("sample_id", "participant_id", "day_index"), ["participant_id", "day_index"], "place")
    return placed.where("place = 100").select("sample_id", "participant_id", "day_index")


def inspect_card(spark, sf_dir):
    """Every sample as numbered lines: nodes, edges, verification summary, first extras."""
    t = DayGraphs(spark, sf_dir)
    nodes, edges = VQ.judged(t)
    node = nodes.select("sample_id", F.lit(1).alias("section"), F.col("pos").alias("ord"), F.format_string("[%s] %s (%s, %s, %s)", "node_id", "label", "type", "polarity", "anchor").alias("line"))
    edge = edges.select("sample_id", F.lit(2).alias("section"), F.col("edge_no").alias("ord"), F.format_string("%s --%s--> %s", "source_node_id", "edge_type", "target_node_id").alias("line"))
    scored = VQ.stored_decisions(t)
    summary = scored.select("sample_id", F.lit(3).alias("section"), F.lit(1).cast("long").alias("ord"), F.format_string(
        "overall: %s nodes mentioned: %d/%d edges expressed: %d/%d", "decision", "nodes_mentioned", "nodes_total", "edges_expressed", "edges_total").alias("line"))
    extras = t.extras().select("sample_id", F.lit(4).alias("section"), F.posexplode(F.slice("extra_content", 1, 5)).alias("ord", "x")).select(
        "sample_id", "section", F.col("ord").cast("long").alias("ord"), F.concat(F.lit("- "), F.trim("x.content"), F.lit(': "'), "x.evidence", F.lit('"')).alias("line"))
    return node.unionByName(edge).unionByName(summary).unionByName(extras).withColumn("section", F.col("section").cast("long"))


def dataset_order(spark, sf_dir):
    return DayGraphs(spark, sf_dir).samples().orderBy("participant_id", "day_index").select("participant_id", "day_index", "sample_id")


def digest_score(*parts):
    """A score from a digest of the text and what is asked of it: a stand-in for a model that SQL can repeat."""
    return hex_number(F.md5(F.concat_ws(":", *parts)), 1, 6) % 1000 / 1000.0


def extract_graphs(spark, sf_dir):
    """Graphs of all texts at the published thresholds; the scorers digest the text (fitted ones: ``model_queries.extract_fitted``)."""
    t = DayGraphs(spark, sf_dir)
    texts = t.stored("text_digests", lambda: t.texts().select("sample_id", F.md5("text").alias("text")))  # read once per text, not per concept

    def nodes_of(said):
        return said.repartition("sample_id").crossJoin(F.broadcast(t.concepts().select("concept_id"))).select(  # the closed vocabulary
            "sample_id", "concept_id", digest_score("text", "concept_id").alias("score"))

    def pairs_of(said, pairs):
        return pairs.join(said, "sample_id").withColumn("score", digest_score("text", "concept_id_a", "concept_id_b"))

    nodes = t.stored("digest_nodes", lambda: X.extract_nodes(texts, t.concepts(), nodes_of))
    return X.graph_rows(nodes, X.extract_edges(texts, nodes, G.relation_majority(t.nodes(), t.edges()), pairs_of))


QUERIES = {f.__name__: f for f in [
    scan_samples, scan_torn_tail, scan_concepts, scan_split_map, scan_relation_map, scan_notes, sink_examples_by_split, sink_sorted_rewrite,
    sink_append, sink_csv_table, sink_json_summary, lookup_participant_day, lookup_line_index, inspect_card, dataset_order, extract_graphs,
]}
