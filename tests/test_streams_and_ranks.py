"""Streams whose input is late, repeated or out of order; ranks by ranges; documents as lines."""

import datetime
import json
import random

from pyspark.sql import functions as F

import __spark_entry__ as entry
from daygraph.functions.ranking import range_rank
from daygraph.session import fresh_path
from daygraph.sources import files as S
from daygraph.streaming import streams as ST

ENTRY = "participant_id string, sample_id string, entry_no long, entry_date date, concepts array<string>, other string"


def day(n):
    return datetime.date(2024, 1, 1) + datetime.timedelta(n)


def deliver(spark, parts):
    path = fresh_path(spark, "entries")
    for rows in parts:
        spark.createDataFrame(rows, ENTRY).coalesce(1).write.mode("append").parquet(path)
    return ST.source(spark, path, spark.createDataFrame([], ENTRY).schema, 1)


def test_day_diff_in_any_order_with_repeats_and_nulls(spark):
    rng = random.Random(3)
    sets = {(p, n): rng.sample("abcdef", rng.randrange(0, 5)) for p in ("p1", "p2") for n in range(6)}
    rows = [(p, f"{p}_{n}", n, day(n), c, "x") for (p, n), c in sets.items()] + [("p3", "p3_0", 0, day(1), None, "x"), ("p3", "p3_1", 1, day(2), ["a"], None)]
    rng.shuffle(rows)
    parts = [rows[:5], rows[5:6], rows[6:11] + rows[:2], rows[11:], rows[3:4]]
    out = fresh_path(spark, "diffs")
    got = {r.sample_id: (r.first_day, r.added, r.recurring, r.removed) for r in ST.run_day_diff(deliver(spark, parts), out).collect()}
    for (p, n), c in sets.items():
        now, old = set(c), set(sets.get((p, n - 1), []))
        assert got[f"{p}_{n}"] == ((True, 0, 0, 0) if n == 0 else (False, len(now - old), len(now & old), len(old - now)))
    assert got["p3_1"] == (False, 1, 0, 0) and len(got) == len(rows)


def test_day_diff_state_ends(spark):
    parts = [[("p1", "a", 0, day(0), ["x"], "")], [("p1", "b", 1, day(50), ["x"], ""), ("p2", "c", 0, day(50), ["x"], "")], [("p1", "d", 2, day(51), ["x"], "")]]
    out = fresh_path(spark, "diffs")
    ST.run_day_diff(deliver(spark, parts), out)
    kept = [sorted(r.sample_id for r in spark.read.parquet(f"{out}/state/batch={n}").collect()) for n in range(3)]
    assert kept == [["a"], ["b", "c"], ["c", "d"]]  # "a" is too old, "b" has both neighbours


def test_late_records_are_left_out_and_counted(spark):
    rows = entry.queries()["stream_decision_rates"](spark, "/root/testdata/sf0.001")
    assert rows.where("NOT late_dropped").count() == 0 and rows.count() > 0


def test_ranks_by_ranges_have_no_gaps(spark):
    rows = spark.createDataFrame([(random.Random(i).randrange(400), i) for i in range(2000)], "k int, i int").repartition(7)
    got = [(r.k, r.i) for r in range_rank(rows, ["k", "i"], "at").orderBy("at").collect()]
    assert got == sorted(got) and [r.at for r in range_rank(rows, ["k", "i"], "at").orderBy("at").collect()] == list(range(2000))
    assert range_rank(rows.where("k < 0"), ["k"], "at").count() == 0


def test_summary_lines_are_one_document(spark):
    path = fresh_path(spark, "summary")
    table = spark.createDataFrame([(f'k"{i:03}', i) for i in range(300)], "name string, n long").repartition(5)
    S.write_json_summary(table, path, "name", "n")
    files = sorted((r.f, r.b, r.value) for r in spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("f"), F.col("_metadata.file_block_start").alias("b")).collect())
    assert json.loads("".join(v for _, _, v in files)) == {f'k"{i:03}': i for i in range(300)}
    assert list(json.loads("".join(v for _, _, v in files))) == sorted(f'k"{i:03}' for i in range(300))


def test_notes_keep_their_own_time(spark):
    path = fresh_path(spark, "archive")
    rows = [("a/x.md", "one\r\n\ntwo  ", datetime.datetime(2020, 5, 6, 7)), ("a/y.md", "", None), ("a/z.md", None, None)]
    S.write_note_archive(spark.createDataFrame(rows, "path string, raw string, modified timestamp"), path)
    back = {r.path: (r.raw, r.modified) for r in S.read_note_archive(spark, path).collect()}
    assert back["a/x.md"] == rows[0][1:] and back["a/y.md"][0] == "" and back["a/z.md"][0] is None
    assert back["a/y.md"][1] is not None and abs((back["a/y.md"][1] - datetime.datetime.now()).days) <= 1


def test_whole_notes_below_a_folder(spark):
    path = fresh_path(spark, "vault")
    spark.createDataFrame([("a", "x\n\ny"), ("b", "z")], "note string, raw string").write.partitionBy("note").text(path)
    back = {r.path.split("note=")[1][0]: r.raw for r in S.read_notes(spark, path, "*.txt").collect()}
    assert back == {"a": "x\n\ny\n", "b": "z\n"}
