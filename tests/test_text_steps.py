"""Steps on texts: equal to the plain patterns, and no text is shuffled with what belongs to its sample."""

import random
import re

from pyspark.sql import functions as F

from daygraph import constants as C
from daygraph.functions import text as X
from daygraph.operators import extract as EX
from daygraph.operators import prepare as P
from daygraph.operators import texts as TX
from daygraph.operators import verify as V

PIECES = ["```", "`", "![[", "]]", "![", "[[", "|", "[", "]", "](", ")", "#", "## ", "- ", "* ", "+ ", "[x] ", "> ", "**", "__", "*", "_", "---",
          "===", "***", "\t", "  ", " ", "\n", "\n\n\n", "\r\n", "\x0b", " ", "a", "Wort", "#tag/x", "title", ": ", "mood: 3", "date:", "ü"]


def odd_texts(n, start=""):
    rng = random.Random(7)
    return [start + "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def plain_clean(body):
    out = body
    for pattern, replacement in X.MARKDOWN_STEPS:
        out = F.regexp_replace(out, pattern, replacement)
    return F.regexp_replace(out, r"^\s+|\s+\z", "")


def test_cleaning_equals_the_plain_patterns(spark):
    df = spark.createDataFrame([(t,) for t in [None, "", *odd_texts(3000)]], "t string")
    out = df.select("t", plain_clean(F.col("t")).alias("want"), X.clean_markdown(F.col("t")).alias("got")).collect()
    assert [r for r in out if r.want != r.got] == []
    assert sum(r.want != r.t for r in out) > 1000


def test_front_block_equals_the_plain_pattern(spark):
    block = re.compile(r"\A---\n([\s\S]*?)\n---[ \t\n\x0b\f\r]*\n?([\s\S]*)\Z")
    texts = ["---\n---\nx", "---\n\n---", "---\na: 1\na: 2\n---x", *odd_texts(1500, "---\n"), *odd_texts(300)]
    df = spark.createDataFrame([(None,), *[(t,) for t in texts]], "t string")
    for r in df.select("t", X.front_fields(F.col("t")).alias("f"), X.front_body(F.col("t")).alias("b")).collect():
        found = block.match(r.t) if r.t is not None else None
        if found is None:
            assert (r.f, r.b) == (None, r.t)
            continue
        want = {}
        for line in found[1].split("\n"):
            if ":" in line and line.split(":", 1)[0].strip(" "):
                want[line.split(":", 1)[0].strip(" ")] = line.split(":", 1)[1].strip(" ")
        assert r.f == want and r.b == found[2].strip(X.BLANKS)




def test_time_words_meet_the_graph_without_their_text(spark):
    texts = spark.createDataFrame([("s1", "en", "All is well tomorrow, as yesterday."), ("s2", "en", "tomorrow"), ("s3", "de", "Bis morgen."), ("s4", "en", None)],
                                  "sample_id string, language string, text string")
    nodes = spark.createDataFrame([("s1", -1), ("s1", 0), ("s2", 1)], "sample_id string, day_offset int")
    out = V.time_extras(texts, nodes)
    assert {r.sample_id: [x.content.split("'")[1] for x in r.time_extras] for r in out.collect()} == {"s1": ["tomorrow"], "s2": [], "s3": ["morgen"], "s4": []}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = out._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    above = plan[:plan.index("Join")]
    assert "text#" not in above and "low#" not in above


def test_texts_come_last_to_node_examples(spark):
    samples = spark.createDataFrame([("s1", "p", 1, "en", 2), ("s2", "p", 2, "en", 1)], "sample_id string, participant_id string, day_index int, language string, n_nodes long")
    nodes = spark.createDataFrame([("s1", "b_01", "b 01"), ("s1", "a_00", "a 00"), ("s1", "b_01", "b 01")], "sample_id string, concept_id string, label string")
    seen = []

    def with_texts(df):
        seen.append(df.columns)
        return df.withColumn("text", F.concat(F.lit("text of "), "sample_id"))

    (row,) = P.node_examples(samples, nodes, with_texts).collect()
    assert (row.sample_id, row.labels, row.label_surface, row.num_nodes, row.text) == ("s1", ["a_00", "b_01"], ["a 00", "b 01"], 2, "text of s1")
    assert "labels" in seen[0]


def test_rewrite_needs_signs_only(spark):
    df = spark.createDataFrame([("de", "Bis morgen.", [1]), ("de", "Bis morgen.", [0]), ("en", "Bis morgen.", [0])], "l string, t string, o array<int>")
    signs = TX.rewrite_signs(F.col("t"), F.lower("t"), F.col("l"))
    assert [r[0] for r in df.select(TX.needs_rewrite(signs, F.col("o"))).collect()] == [False, True, False]


def test_edges_of_extracted_graphs_sort_no_pairs(spark):
    nodes = spark.createDataFrame([("s1", "a", "event", "neutral", 1, "n1"), ("s1", "b", "emotion", "neutral", 2, "n2"), ("s1", "c", "thought", "neutral", 3, "n3")],
                                  "sample_id string, concept_id string, type string, polarity string, rank long, node_id string")
    texts = spark.createDataFrame([("s1", "t")], "sample_id string, text string")
    relations = spark.createDataFrame([("event", "emotion", "causes", 2), ("emotion", "event", "eases", 3)], "src_type string, dst_type string, relation string, n long")
    value = {"ab": 0.9, "ba": 0.5, "ac": 0.9, "ca": 0.0, "bc": 0.2, "cb": 1.0}
    table = F.create_map(*[F.lit(x) for kv in value.items() for x in kv])
    out = EX.extract_edges(texts, nodes, relations, lambda said, pairs: pairs.join(said, "sample_id").withColumn("score", table[F.concat("concept_id_a", "concept_id_b")]), 0.6)
    got = {(r.node_id_a, r.node_id_b, round(r.p, 3), r.reversed, r.relation) for r in out.collect()}
    assert got == {("n1", "n2", 0.7, True, "eases"), ("n2", "n3", 0.6, False, C.DEFAULT_RELATION)}
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()
