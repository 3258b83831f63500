"""Keyed orders of pair numbers: complete, without repeats, and even over seeds."""

import collections

from pyspark.sql import functions as F

from daygraph.operators import prepare as P


def numbers(spark, total, draws, keys=1, seed=1):
    plan = spark.createDataFrame([(f"g{i}", total, draws) for i in range(keys)], "sample_id string, total long, draws long")
    return P.permuted_numbers(plan, ["sample_id"], "draws", "total", seed)


def test_every_number_comes_once(spark):
    for total in (1, 2, 3, 6, 64, 1000):
        got = [r.number for r in numbers(spark, total, total).collect()]
        assert sorted(got) == list(range(total))


def test_enough_numbers_are_found_in_a_large_range(spark):
    total = (1 << 33) + 5  # the worst ratio: half of the places are passed over
    got = [r.number for r in numbers(spark, total, 5000).collect()]
    assert len(got) == len(set(got)) >= 5000 and max(got) < total


def test_draws_are_even_over_seeds(spark):
    seen, couples = collections.Counter(), collections.Counter()
    ordered = numbers(spark, 6, 2, keys=2000).groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct("draw", "number"))).alias("x"))
    for r in ordered.collect():
        seen[r.x[0].number] += 1
        couples[tuple(sorted(x.number for x in r.x[:2]))] += 1
    assert len(seen) == 6 and sum((n - 2000 / 6) ** 2 / (2000 / 6) for n in seen.values()) < 20.5  # chi square, 5 degrees, 0.001
    assert len(couples) == 15 and sum((n - 2000 / 15) ** 2 / (2000 / 15) for n in couples.values()) < 36.2  # 14 degrees


def test_random_negatives_of_a_four_node_graph(spark):
    nodes = spark.createDataFrame(
        [(f"g{i}", p, f"n{p}", "event", "event_00", "event 00", "mixed") for i in range(400) for p in range(1, 5)],
        "sample_id string, pos long, node_id string, type string, concept_id string, label string, polarity string")
    edges = spark.createDataFrame(
        [(f"g{i}", f"e{k}", f"n{k}", f"n{k + 1}", "causes") for i in range(400) for k in (1, 2)],
        "sample_id string, edge_id string, source_node_id string, target_node_id string, edge_type string")
    got = collections.Counter((r.sample_id, r.node_a, r.node_b) for r in P.negatives_random(nodes, edges).collect())
    assert max(got.values()) == 1 and len(got) == 800  # two of the four free pairs each
    free = collections.Counter(k[1:] for k in got.elements())
    assert set(free) == {("n1", "n3"), ("n1", "n4"), ("n2", "n4"), ("n3", "n4")}
    assert all(abs(n - 200) < 50 for n in free.values())
