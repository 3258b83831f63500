"""Literal rows for the cases the generated tables do not hold, and brute force for the linear methods."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from daygraph.functions import ranking as RK
from daygraph.functions import text as X
from daygraph.operators import evaluate as E
from daygraph.operators import graph as G
from daygraph.operators import journal as J
from daygraph.operators import prepare as P
from daygraph.operators import texts as TX
from daygraph.sources import files as S
from daygraph.operators import verify as V
from daygraph.sources.day_graphs import DayGraphs

NODE_SCHEMA = "sample_id string, participant_id string, pos long, node_id string, concept_id string, type string, label string, polarity string, confidence double, day_offset int, temporal_status string, anchor string"
EDGE_SCHEMA = "sample_id string, participant_id string, edge_no long, edge_id string, source_node_id string, target_node_id string, edge_type string, weight double"


def graph(spark, sizes, edge_share=0.4, seed=1):
    """Random graphs, one of them much larger than the rest."""
    rng = random.Random(seed)
    nodes, edges = [], []
    for s, n in enumerate(sizes):
        sid = f"p0_d{s:02d}"
        for i in range(1, n + 1):
            kind = rng.choice(["event", "emotion", "activity", "coping_action"])
            pol = rng.choice(["negative", "positive", "neutral", "mixed"])
            nodes.append((sid, "p0", i, f"n{i}", f"{kind}_{rng.randint(0, 2)}", kind, kind, pol, rng.random(), 0, "present", "now"))
        k = 0
        for a, b in itertools.combinations(range(1, n + 1), 2):
            if rng.random() < edge_share:
                k += 1
                a2, b2 = (a, b) if rng.random() < 0.5 else (b, a)
                edges.append((sid, "p0", k, f"e{k}", f"n{a2}", f"n{b2}", "causes", 0.5))
    return spark.createDataFrame(nodes, NODE_SCHEMA), spark.createDataFrame(edges, EDGE_SCHEMA), nodes, edges


def test_row_number_of_a_hot_group(spark):
    rows = [("hot", i * 3) for i in range(500)] + [("cold", i) for i in range(5)]
    df = spark.createDataFrame(rows, "g string, v long").repartition(7)
    out = RK.grouped_row_number(df, ["g"], ["v"], F.floor(F.col("v") / 50), "r", hot_rows=20).collect()
    assert all(r.r == (r.v // 3 + 1 if r.g == "hot" else r.v + 1) for r in out)


def test_nodes_of_a_hot_sample_keep_their_positions(spark):
    t = DayGraphs(spark, "/root/testdata/sf0.001")
    plain = {tuple(r) for r in t.derive_nodes().select("sample_id", "event_id", "pos").collect()}
    salted = {tuple(r) for r in t.derive_nodes(hot_rows=1).select("sample_id", "event_id", "pos").collect()}
    assert plain == salted


def test_prefix_sum_and_expansion(spark):
    df = spark.createDataFrame([("a", i, i % 4) for i in range(100)], "g string, o long, v long")
    out = RK.bucketed_prefix_sum(df, ["g"], ["o"], F.floor(F.col("o") / 9), "v", "s").orderBy("o").collect()
    assert [r.s for r in out] == [sum(i % 4 for i in range(j)) for j in range(100)]
    many = RK.expand_counts(spark.createDataFrame([("a", 25), ("b", 0), ("c", 1)], "g string, n long"), ["g"], "n", "i", block=10)
    assert sorted((r.g, r.i) for r in many.collect()) == [("a", i) for i in range(25)] + [("c", 0)]


def test_nearest_rank_rounds_half_to_even(spark):
    df = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 6)], "v long")
    r = RK.nearest_rank(df, [], "v", {"p50": 0.5, "p90": 0.9}).first()
    assert (r.n, r.p50, r.p90) == (6, 3, 5)  # round(2.5) = 2, round(4.5) = 4


def test_unrank_lists_every_pair_once(spark):
    low, high = P.unrank(F.col("id"))
    got = [(r.a, r.b) for r in spark.range(10 * 9 // 2).select(low.alias("a"), high.alias("b")).collect()]
    assert sorted(got) == sorted(itertools.combinations(range(10), 2))


def test_self_dangling_and_double_edges(spark):
    nodes = spark.createDataFrame(
        [("s", "p", i, f"n{i}", f"c{i}", "event", "x", "negative", 0.5, 0, "present", "now") for i in (1, 2, 10)], NODE_SCHEMA)
    edges = spark.createDataFrame([
        ("s", "p", 1, "e1", "n1", "n1", "causes", 1.0), ("s", "p", 2, "e2", "n1", "gone", "causes", 1.0),
        ("s", "p", 3, "e3", "n2", "n10", "causes", 1.0), ("s", "p", 4, "e4", "n10", "n2", "follows", 1.0)], EDGE_SCHEMA)
    pairs = G.connected_pairs(nodes, edges).collect()
    assert [(p.node_id_a, p.node_id_b, p.n_edges) for p in pairs] == [("n10", "n2", 2)]  # ids order as strings
    r = G.typepair_connectivity(nodes, edges).first()
    assert (r.cooccur, r.connected) == (3, 1)


def test_one_node_graph_has_no_pairs(spark):
    nodes, edges, *_ = graph(spark, [1, 2], edge_share=1.0)
    assert {r.sample_id for r in G.pair_counts(nodes).collect()} == {"p0_d01"}


@pytest.mark.parametrize("chunk", [3, 4096])
def test_compat_relation_equals_listing_all_pairs(spark, chunk):
    nodes, edges, n, e = graph(spark, [14, 4, 1])
    linked = {(x[0], frozenset((x[4], x[5]))) for x in e}
    want = {}
    for a, b in itertools.combinations(n, 2):
        if a[0] == b[0] and (a[0], frozenset((a[3], b[3]))) not in linked:
            key = (a[5], a[7], b[5], b[7])
            want[key] = want.get(key, 0) + 1
    got = {(r.type_a, r.polarity_a, r.type_b, r.polarity_b): r.n_unconnected for r in G.compat_relation(nodes, edges, chunk).collect()}
    assert got == want


def test_random_negatives_of_a_skewed_set(spark):
    nodes, edges, n, e = graph(spark, [30, 3, 5, 2, 1], edge_share=0.3)
    positive = {(x[0], *sorted((x[4], x[5]))) for x in e}
    got = [(r.sample_id, r.node_a, r.node_b) for r in P.negatives_random(nodes, edges, 1.0).collect()]
    assert len(got) == len(set(got)) and not set(got) & positive
    for s in {x[0] for x in n}:
        size = sum(x[0] == s for x in n)
        pos = sum(p[0] == s for p in positive)
        assert sum(g[0] == s for g in got) == min(size * (size - 1) // 2 - pos, pos)


def test_hard_negatives_of_a_skewed_set(spark):
    nodes, edges, n, e = graph(spark, [40, 3, 5, 2, 6], edge_share=0.45)
    nodes = nodes.withColumn("split", F.lit("train"))
    plan = P.hard_plan(nodes, edges)
    got = [(r.sample_id, r.node_a, r.node_b, r.type_pair) for r in P.negatives_hard(nodes, edges, plan).collect()]
    positive = {(x[0], *sorted((x[4], x[5]))) for x in e}
    assert len(got) == len(set(got)) and not {g[:3] for g in got} & positive
    kind = {(x[0], x[3]): x[5] for x in n}
    assert all(g[3] == "__".join(sorted((kind[g[0], g[1]], kind[g[0], g[2]]))) for g in got)
    for row in plan.collect():
        assert sum(g[3] == row.type_pair for g in got) == row.take


def greedy(targets, pools):
    """One by one, as the rule is stated."""
    pools, taken = dict(pools), {}
    short = {}
    for tp in sorted(targets):
        for _ in range(targets[tp]):
            if pools.get(tp, 0) > 0:
                pools[tp] -= 1
                taken[tp] = taken.get(tp, 0) + 1
            else:
                short[tp] = short.get(tp, 0) + 1
    for tp in sorted(short):
        near = [q for q in pools if set(q.split("__")) & set(tp.split("__"))]
        far = [q for q in pools if q not in near]
        order = sorted(near, key=lambda q: (-pools[q], q)) + sorted(far, key=lambda q: (-pools[q], q))
        for q in order:
            while short[tp] and pools[q]:
                pools[q] -= 1
                short[tp] -= 1
                taken[q] = taken.get(q, 0) + 1
    return taken


def test_fill_plan_equals_one_by_one():
    rng = random.Random(5)
    kinds = ["a", "b", "c", "d"]
    names = ["__".join(p) for p in itertools.combinations_with_replacement(kinds, 2)]
    for _ in range(200):
        pools = {n: rng.randint(0, 9) for n in names}
        targets = {n: rng.randint(0, 12) for n in rng.sample(names, 6)}
        total, _ = P.fill_plan(targets, pools)
        assert {k: v for k, v in total.items() if v} == greedy(targets, pools)


def test_chains_of_a_dense_graph_keep_the_first_fifty(spark):
    nodes, edges, n, e = graph(spark, [16, 3], edge_share=0.9, seed=3)
    concept = {(x[0], x[3]): x[4] for x in n}
    pos = {(x[0], x[3]): x[2] for x in n}
    want = []
    for s in ("p0_d00", "p0_d01"):
        paths = []
        mine = [x for x in e if x[0] == s]
        for x, y in itertools.product(mine, mine):
            a, b, c = concept[s, x[4]], concept[s, x[5]], concept[s, y[5]]
            if x[5] == y[4] and len({a, b, c}) == 3:
                paths.append((pos[s, x[4]], x[2], y[2], a, b, c))
        want += [(s, i + 1, *p[3:]) for i, p in enumerate(sorted(paths)[:50])]
    entries = nodes.select("sample_id", "participant_id").distinct().withColumn("entry_date", F.lit("2024-01-01").cast("date")).withColumn("mood_score", F.lit(1.0))
    got = [(r.sample_id, r.path_no, r.a, r.b, r.c) for r in J.Journal(entries, nodes, edges).chains.collect()]
    assert sorted(got) == sorted(want)


def journal_of(spark, days, moods=None, short=()):
    """One participant; ``days`` maps a day number to its concepts."""
    nodes, entries = [], []
    for d, concepts in days.items():
        sid = f"p_d{d:03d}"
        entries.append((sid, "p", d, (moods or {}).get(d), d not in short))
        for i, (c, kind, pol) in enumerate(concepts, 1):
            nodes.append((sid, "p", i, f"n{i}", c, kind, c, pol, 0.5, 0, "present", "now"))
    frame = spark.createDataFrame(entries, "sample_id string, participant_id string, d int, mood_score double, eligible boolean")
    frame = frame.withColumn("entry_date", F.expr("date_add(DATE '2026-06-01', d - 1)")).drop("d")
    return J.Journal(frame, spark.createDataFrame(nodes, NODE_SCHEMA), spark.createDataFrame([], EDGE_SCHEMA))


PRESSURE, WALK = ("deadline", "stressor", "negative"), ("walk", "activity", "positive")


def test_published_summary_arithmetic(spark):
    """Fourteen days, a problem on days 2 to 9, a walk on the rest: threshold 3, trend 6/7 against 2/7."""
    days = {d: [PRESSURE] if 2 <= d <= 9 else [WALK] for d in range(1, 15)}
    moods = dict(zip(range(1, 15), [6.8, 5.9, 4.9, 4.3, 3.6, 3.8, 4.7, 5.2, 5.0, 6.4, 6.8, 7.2, 7.3, 7.6]))
    j = journal_of(spark, days, moods)
    r = j.recurring.first()
    assert (r.days, r.total_days, r.threshold) == (8, 14, 3)
    h = j.half_counts.first()
    assert (h.first_days, h.second_days, h.trend) == (6, 2, "decreasing")
    m = j.mood_overview.select(J.fixed1(F.col("mean")).alias("mean"), J.signed1(F.col("net")).alias("net"), "direction", "volatility", F.col("best_date").cast("string"), F.col("worst_date").cast("string")).first()
    assert tuple(m) == ("5.7", "+0.8", "up", "moderate", "2026-06-14", "2026-06-05")
    assert j.span.first().gap_days == 0
    assert [r.concept_id for r in j.never_with_coping.collect()] == ["deadline"]


def test_streak_breaks_at_short_entries_and_is_capped(spark):
    days = {d: [PRESSURE] for d in range(1, 131)}
    got = {int(r.sample_id[3:]): r.streak for r in journal_of(spark, days, short={100}).concept_streaks.collect()}
    assert got[1] == 1 and got[60] == 60 and got[61] == 61 and got[99] == 61
    assert 100 not in got and got[101] == 1 and got[130] == 30


def test_thresholds_on_the_grid(spark):
    df = spark.createDataFrame([(x,) for x in (0.04, 0.05, 0.58, 0.5799999, 0.95, 1.0, 0.0)], "s double")
    steps = [r[0] for r in df.select(E.grid_step(F.col("s"))).collect()]
    assert steps == [sum(i / 100.0 <= x for i in range(5, 96)) for x in (0.04, 0.05, 0.58, 0.5799999, 0.95, 1.0, 0.0)]


def test_auc_with_ties_and_one_class(spark):
    rows = [("a", 1, 0.5), ("a", 0, 0.5), ("a", 1, 0.9), ("a", 0, 0.1), ("b", 1, 0.3)]
    got = {r.k: r.auc for r in E.roc_auc(spark.createDataFrame(rows, "k string, gold int, score double"), ["k"]).collect()}
    assert got == {"a": 0.875, "b": None}


def test_only_exact_true_counts_and_the_last_verdict_wins(spark):
    nodes = spark.createDataFrame([("s", "n1"), ("s", "n2"), ("s", "n3")], "sample_id string, node_id string")
    verdicts = spark.createDataFrame(
        [("s", "n1", 1, True, True), ("s", "n1", 2, False, True), ("s", "n2", 3, None, True)],
        "sample_id string, node_id string, ord long, mentioned boolean, temporal_correct boolean")
    got = {r.node_id: (r.mentioned, r.n_verdicts) for r in V.judged_nodes(nodes, verdicts).collect()}
    assert got == {"n1": (False, 2), "n2": (False, 1), "n3": (False, 0)}


def test_empty_graph_scores_one_and_unparsed_scores_zero(spark):
    s = spark.createDataFrame([("a", "en", "x", True), ("b", "en", "x", False)], "sample_id string, language string, scenario string, parsed boolean")
    nodes = spark.createDataFrame([], "sample_id string, mentioned boolean, temporal_correct boolean, n_verdicts long")
    edges = spark.createDataFrame([], "sample_id string, expressed boolean, n_verdicts long")
    extras = spark.createDataFrame([], "sample_id string, n long")
    got = {r.sample_id: (r.node_coverage, r.hallucination_score, r.overall_confidence, r.decision) for r in V.decisions(V.scores(s, nodes, edges, extras)).collect()}
    assert got["a"] == (1.0, 0.0, 1.0, "accept") and got["b"] == (0.0, 1.0, 0.0, "reject")


def test_german_tomorrow(spark):
    texts = ["Ich hoffe, morgen wird es besser.", "Heute morgen war es kalt.", "Am Morgen lief ich.", "morgens und übermorgen", "heute morgen und morgen"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("low", F.lower("t"))
    none = F.array().cast("array<int>")
    got = [[x.content for x in r[0] if "'morgen'" in x.content] for r in df.select(X.time_extras(F.col("t"), F.col("low"), F.lit("de"), none)).collect()]
    assert [len(g) for g in got] == [1, 0, 0, 0, 1]


def test_banned_phrases_respect_german_letters(spark):
    df = spark.createDataFrame([("die fußkante",), ("an der kante",), ("symptomen",), ("es führte zu streit",)], "t string")
    assert [r[0] for r in df.select(X.banned_de(F.col("t"))).collect()] == [[], ["kante"], ["symptom"], ["führte zu"]]


def test_dates_fall_through_when_impossible(spark):
    cases = {"2026-07-14 Monday": "2026-07-14", "2026-02-30": None, "31.02.2026 then": None, "14.07.2026": "2026-07-14", "d20260714x": "2026-07-14",
             "1899-01-01": None, "2026-13-01 14.07.2026": "2026-07-14", "nothing": None}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert [r[0] for r in df.select(X.parse_date(F.col("t"))).collect()] == list(cases.values())


def test_front_block(spark):
    raw = "---\ndate: 2026-06-01\nmood: none\nrating: 4\nmood_score:\n---\n\nBody\n"
    df = spark.createDataFrame([(raw,), ("no block",)], "r string")
    got = df.select(X.mood_alias(X.front_fields(F.col("r"))).alias("m"), X.front_body(F.col("r")).alias("b")).collect()
    assert tuple(got[0]) == (0.0, "Body") and tuple(got[1]) == (None, "no block")


def test_lexicon_of_all_lengths(spark):
    long = "ab" * 2000 + "needle in a long text" + "é" * 3000 + "tail"
    rows = [("a", "The Sleep Loss and noise"), ("b", "sleeploss"), ("c", "x"), ("d", ""), ("e", None), ("f", long)]
    words = {"1": "sleep loss", "2": "loss", "3": "noise", "4": "zzz", "5": "x", "6": "No", "7": "and", "8": "needle in a long text", "9": "éta", "10": ""}
    texts = spark.createDataFrame(rows, "sample_id string, text string")
    lexicon = spark.createDataFrame(list(words.items()), "concept_id string, label string")
    want = {(s, c) for s, t in rows if t is not None for c, w in words.items() if w.lower() in t.lower()}
    for limit in (0, 100):
        got = [tuple(r) for r in TX.lexicon_match(texts, lexicon, limit).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_lexicon_of_many_labels(spark):
    texts = spark.createDataFrame([(f"s{i}", f"this is label {i * 37:06d} here") for i in range(200)], "sample_id string, text string")
    lexicon = spark.range(100_000).selectExpr("cast(id as string) AS concept_id", "concat('label ', lpad(cast(id as string), 6, '0')) AS label")
    got = {(r.sample_id, r.concept_id) for r in TX.lexicon_match(texts, lexicon).collect()}
    assert got == {(f"s{i}", str(i * 37)) for i in range(200)}


def test_rewrite_is_published_by_one_rename(spark, tmp_path):
    path, order, schema = str(tmp_path / "set"), ["k"], "k long, v string"
    S.write_sorted(spark.createDataFrame([(i * 7 % 100, "old") for i in range(100)], schema), path, order)
    old = S.current_version(spark, path)
    broken = spark.range(50).select(F.col("id").alias("k"), F.when(F.col("id") == 33, F.raise_error(F.lit("killed"))).otherwise(F.lit("new")).alias("v"))
    with pytest.raises(Exception, match="killed"):
        S.write_sorted(broken, path, order)
    back = S.read_sorted(spark, path, schema, order)
    assert S.current_version(spark, path) == old and sorted((r.place, r.k, r.v) for r in back.collect()) == [(i, i, "old") for i in range(100)]
    S.write_sorted(spark.range(10).selectExpr("9 - id AS k", "'new' AS v"), path, order)
    assert sorted((r.place, r.k, r.v) for r in S.read_sorted(spark, path, schema, order).collect()) == [(i, i, "new") for i in range(10)]


def test_split_ratios_must_sum_to_one(spark):
    people = spark.createDataFrame([("p1", "en")], "participant_id string, language string")
    with pytest.raises(ValueError):
        P.stratified_split(people, {"train": 0.5, "dev": 0.3, "test": 0.3})


def test_split_sizes_and_disjointness(spark):
    people = spark.createDataFrame([(f"p{i}", "en" if i % 3 else "de") for i in range(50)], "participant_id string, language string")
    got = P.stratified_split(people).collect()
    assert len({r.participant_id for r in got}) == len(got) == 50
    for lang, n in (("en", 33), ("de", 17)):
        sizes = {s: sum(r.split == s and r.language == lang for r in got) for s in ("train", "dev", "test")}
        assert sizes["train"] == round(n * 0.5) and sizes["dev"] == round(n * 0.3)


def test_unseen_labels(spark):
    index = P.label_index(spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "y")], "sample_id string, concept_id string"), common_min=2)
    assert [(r.concept_id, r.idx, r.is_common) for r in index.orderBy("idx").collect()] == [("x", 0, True), ("y", 1, False)]
    test = spark.createDataFrame([("c", "x"), ("c", "z")], "sample_id string, concept_id string")
    assert [r.concept_id for r in P.unseen_labels(test, index).collect()] == ["z"]


def test_reasons_keep_one_shape_for_large_graphs(spark):
    """1,500 nodes: an accepted graph has its head; a review graph counts all issues in one row."""
    from daygraph.operators import verify as V
    nodes = spark.range(1, 1501).select(
        F.lit("s").alias("sample_id"), F.col("id").alias("pos"), F.concat(F.lit("n"), "id").alias("node_id"), F.concat(F.lit("l"), "id").alias("label"),
        F.lit("today").alias("anchor"), (F.col("id") % 5 != 0).alias("mentioned"), F.lit(True).alias("temporal_correct"))
    edges = spark.createDataFrame([("s", 1400, "n1400", "n1401", False)], "sample_id string, edge_no long, source_node_id string, target_node_id string, expressed boolean")
    extras = spark.createDataFrame([("s", ["x"])], "sample_id string, contents array<string>")
    head = "sample_id string, decision string, parsed boolean, bad_nodes long, bad_edges long, nodes_total long, edges_total long"
    for decision, rows, text in [("accept", 1, "complete: 1500 nodes, 1 relations"),
                                 ("review", 303, "unclear nodes: 300, silent relations: 1, wrong times: 0, extras: 1")]:
        got = V.reasons(spark.createDataFrame([("s", decision, True, 0, 0, 1500, 1)], head), nodes, edges, extras).collect()
        assert len(got) == rows and [r.item for r in got if r.kind == "decision"] == [text]


def test_gate_sees_rounded_shares(spark):
    from daygraph.operators import verify as V
    counted = spark.createDataFrame([(True, 25_000, 24_999, 25_000, 0, 0, 0, 0, 0)],
                                    "parsed boolean, nodes_total long, nodes_mentioned long, nodes_timed long, edges_total long, edges_expressed long, hallucination_count long, bad_nodes long, bad_edges long")
    assert V.decisions(V.with_shares(counted)).first().decision == "accept"


def test_graph_hash_covers_weights_and_confidences(spark):
    from daygraph.operators import verify as V
    from daygraph.sources.day_graphs import DayGraphs
    t = DayGraphs(spark, "/root/testdata/sf0.001")
    old = {r.sample_id: r.graph_hash for r in V.graph_hash(t.nodes(), t.edges()).collect()}
    one = t.edges().first()
    weight = F.when((F.col("sample_id") == one.sample_id) & (F.col("edge_id") == one.edge_id), 0.01).otherwise(F.col("weight"))
    new = {r.sample_id: r.graph_hash for r in V.graph_hash(t.nodes(), t.edges().withColumn("weight", weight)).collect()}
    assert {k for k in old if old[k] != new[k]} == {one.sample_id}
    doubt = {r.sample_id: r.graph_hash for r in V.graph_hash(t.nodes().withColumn("confidence", F.lit(0.01)), t.edges()).collect()}
    assert all(old[k] != doubt[k] for k in old)


def test_markup_is_no_entry(spark):
    from daygraph.functions import text as X
    rows = spark.createDataFrame([("**  **  __ __ ## ##  --- ---",), ("a plain text that is long enough",)], "text string")
    assert [r.n >= 15 for r in rows.select(F.length(X.clean_markdown(F.col("text"))).alias("n")).collect()] == [False, True]


def test_cluster_without_shared_folder_is_an_error():
    from types import SimpleNamespace

    from daygraph import session
    none = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)))
    with pytest.raises(ValueError):
        session.shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=context))
