"""Plans that must not send large tables through the driver, and texts that must not be shuffled."""

from pyspark.sql import functions as F

from daygraph.functions import ranking as RK
from daygraph.operators import prepare as P
from daygraph.plans import io_queries
from daygraph.session import FILE_FACTOR, UNPACKED
from daygraph.sources.day_graphs import DayGraphs


def analyzed(df):
    return df._jdf.queryExecution().analyzed().toString()


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def tiny_graph(spark):
    nodes = [("s1", "train", i, f"n{i}", f"c{i}", "event" if i % 2 else "emotion", "neutral") for i in range(1, 9)]
    frame = spark.createDataFrame(nodes, "sample_id string, split string, pos long, node_id string, concept_id string, type string, polarity string")
    edges = spark.createDataFrame([("s1", "e1", "n1", "n2"), ("s1", "e2", "n3", "n4")], "sample_id string, edge_id string, source_node_id string, target_node_id string")
    return frame.withColumn("label", F.col("concept_id")), edges


def test_draws_of_hard_negatives_are_never_broadcast(spark):
    nodes, edges = tiny_graph(spark)
    out = P.negatives_hard(nodes, edges, P.hard_plan(nodes, edges))
    assert "strategy=merge" in analyzed(out)
    assert out.count() == 2


def test_tables_count_with_their_size_in_memory(spark):
    t = DayGraphs(spark, "/root/testdata/sf0.001")
    assert float(spark.conf.get(FILE_FACTOR)) >= UNPACKED
    size = int(str(t.nodes()._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    rows = t.nodes().count()
    assert size > 100 * rows


def test_prep_report_reads_its_written_parts_only(spark):
    """the report's blocks repeated the jobs behind them in one plan on the driver."""
    from daygraph.plans.report_queries import prep_report

    report = prep_report(spark, "/root/testdata/sf0.001")
    assert all("/prep-" in f for f in report.inputFiles())
    assert {r.section for r in report.select("section").distinct().collect()} == {0, 1, 2, 3, 4, 5}


def test_appended_batches_read_records_joined_once(spark, monkeypatch):
    """before, each batch joined all samples with their decisions again."""
    plans = []
    monkeypatch.setattr(io_queries.S, "append_records", lambda df, path, keep=io_queries.S.append_records: (plans.append(analyzed(df)), keep(df, path)))
    found = io_queries.sink_append(spark, "/root/testdata/sf0.001").collect()
    assert len(plans) == 2 and not any("Join" in p for p in plans)
    assert sum(r.n for r in found) == DayGraphs(spark, "/root/testdata/sf0.001").samples().count()


def test_ranks_where_no_group_is_large_go_through_the_rows_once(spark):
    """F8 to F13: the buckets of groups were counted whatever their size, so all that is behind the rows was done twice."""
    df = spark.createDataFrame([(i % 7, i) for i in range(300)], "g int, v int")
    most = df.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    rank = lambda **more: RK.grouped_row_number(df, ["g"], ["v"], F.floor(F.col("v") / 50), "r", hot_rows=100, **more)
    assert "Join" in analyzed(rank()) and "Join" not in analyzed(rank(most=most))
    large = most.withColumn("n", F.lit(101))
    assert sorted(rank().collect()) == sorted(rank(most=most).collect()) == sorted(rank(most=large).collect())


def test_digests_looked_up_are_those_of_every_draw(spark, monkeypatch):
    """F8 to F13: halves of few values have their digests made once per graph; the numbers stay the same."""
    plan = spark.createDataFrame([("a", 6, 3), ("b", 45, 40), ("c", 5000, 30), ("d", 1, 1), ("e", 10**9, 20)], "sample_id string, total long, draws long")
    draw = lambda: sorted(map(tuple, P.permuted_numbers(plan, ["sample_id"], "draws", "total", 7).select("sample_id", "draw", "number").collect()))
    looked_up = draw()
    monkeypatch.setattr(P, "SMALL_HALF", 0)
    assert draw() == looked_up and len(looked_up) > 90
