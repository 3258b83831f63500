"""Mixing sources to target weights by the cube method.

Sources, by code point with null last, weigh ``WEIGHTS`` in turn and share
``FACTOR`` times all words. A target stops at ``CAP`` times its source's words; the
excess goes to the others by weight until none is above. A document of a source
is then due ``q = target / words of the source`` copies: ``floor(q)`` for certain and
one more with probability ``q - floor(q)``.

Which documents get one more is drawn by the cube method. In its flight phase
three undecided documents at a time move along the null space of the two balance
equations (documents, words) until one of them is decided; a chunk of ``CHUNK``
documents of a source ends with two undecided at most. These meet again, chunk by
chunk, until each source has two left. With ``HELD`` documents that the flights leave
out they are the landing problem: of all its roundings the one closest to the
balance of words is taken.

A hot source is many chunks, dealt by a hash, and by a running number where one
document is there more than ``CHUNK`` times; all sums are partial aggregates, and
only scalars (total words and weights) reach the driver. Chunks, order and draws
depend on ids and texts alone, so reruns agree.

Defined results: null is an empty text of no words; a null source is a source of
its own; documents without words are drawn like others; a source without words has
target 0; repeated rows are documents of their own and may be drawn differently; an
empty table gives an empty result; extra columns are ignored (``mix_documents``
returns them untouched, whatever their names, and names its own column by ``copies_name``).
"""

from __future__ import annotations

import random
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daygraph.llm import words as W
from daygraph.llm.places import placed
from daygraph.session import written

WEIGHTS = (5, 2, 1)
FACTOR, CAP = 1.5, 2.0
#: Documents per flight, and chunks whose undecided documents meet in one later flight.
CHUNK, FAN = 4096, 1024
#: Documents of a source that the flights leave out, so that the landing has sizes to choose from.
HELD = 14
_NEAR = 1e-9


def fly(p: list[float], size: list[int], seed: int) -> list[float]:
    """Flight phase: probabilities move, both totals kept, until two are undecided at most."""
    draw = random.Random(seed)
    p = list(p)
    active: list[int] = []
    waiting = (i for i, x in enumerate(p) if _NEAR < x < 1 - _NEAR)
    while True:
        while len(active) < 3 and (i := next(waiting, None)) is not None:
            active.append(i)
        if len(active) < 2:
            return p
        if len(active) == 3:
            a, b, c = (size[i] for i in active)
            u = (b - c, c - a, a - b)
            if u == (0, 0, 0):
                u = (1, -1, 0)
        elif size[active[0]] == size[active[1]]:
            u = (1, -1)
        else:
            return p
        up = min((1 - p[i]) / d if d > 0 else p[i] / -d for i, d in zip(active, u, strict=True) if d)
        down = min(p[i] / d if d > 0 else (1 - p[i]) / -d for i, d in zip(active, u, strict=True) if d)
        step = up if draw.random() * (up + down) < down else -down
        for i, d in zip(active, u, strict=True):
            x = p[i] + step * d
            p[i] = 0.0 if x < _NEAR else 1.0 if x > 1 - _NEAR else x
        active = [i for i in active if 0 < p[i] < 1]


def held_back(p: list[float], size: list[int]) -> set[int]:
    """``HELD`` undecided documents, spread over the sizes, that stay for the landing."""
    open_ = sorted((i for i, x in enumerate(p) if _NEAR < x < 1 - _NEAR), key=lambda i: (size[i], i))
    return {open_[k * (len(open_) - 1) // (HELD - 1)] for k in range(HELD)} if len(open_) > HELD else set(open_)


def land(p: list[float], size: list[int]) -> list[float]:
    """Rounding of the last undecided ones that is closest to the balance of words, among those within two documents of theirs."""
    left = [i for i, x in enumerate(p) if 0 < x < 1]
    if not left:
        return p
    ways = (np.arange(1 << len(left))[:, None] >> np.arange(len(left))) & 1
    move = ways - np.array([p[i] for i in left])
    words = np.abs(move @ np.array([size[i] for i in left], float))
    words[np.abs(move.sum(1)) > 2] += sum(size) + 1.0
    for i, x in zip(left, ways[words.argmin()].tolist(), strict=True):
        p[i] = float(x)
    return p


def _flight(last: bool):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["size", "content", "doc_id", "row"], ascending=[False, True, True, True], na_position="first")
        chunk = int(group["chunk"].iloc[0])
        seed = zlib.crc32(f"{group['source_key'].iloc[0]}|{chunk}".encode())
        p, size = group["p"].tolist(), group["size"].tolist()
        held = held_back(p, size) if chunk <= 0 else set()
        flown = fly([0.0 if i in held else x for i, x in enumerate(p)], size, seed)
        p = [p[i] if i in held else x for i, x in enumerate(flown)]
        return group.assign(p=land(p, size) if last else p)

    return run


def source_targets(sizes: DataFrame) -> DataFrame:
    """Per source: ``source_key`` (with a mark for null), ``n, source_size, target``; from rows of source_key and size."""
    sums = sizes.groupBy("source_key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    # Ranks without one task for all sources: ranges in order, their counts, and places within.
    ranges = written(sums.repartitionByRange("source_key").withColumn("part", F.spark_partition_id()), "sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    start = ranges.groupBy("part").agg(F.count(F.lit(1)).alias("c")).select("part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"))
    place = F.col("start") + F.row_number().over(Window.partitionBy("part").orderBy("source_key")) - 1
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    ranked = written(ranges.join(start, "part").withColumn("weight", F.get(weights, (place % len(WEIGHTS)).cast("int"))).select(
        "source_key", "n", "source_size", "weight", (F.col("source_size") * CAP).alias("cap")), "weights")
    share, known = (ranked.agg(F.sum("source_size")).first()[0] or 0) * FACTOR, -1
    level, left, weight = 0.0, share, 1.0
    while True:
        # Sources whose share would be above their cap; raising the level only adds to them.
        above = F.lit(level) * F.col("weight") > F.col("cap")
        capped, n, rest = ranked.agg(F.sum(F.when(above, F.col("cap"))), F.count(F.when(above, 1)), F.sum(F.when(~above, F.col("weight")))).first()
        if n == known or not rest:
            break
        known, left, weight = n, share - (capped or 0), rest
        level = left / weight
    above = F.lit(level) * F.col("weight") > F.col("cap")
    return ranked.select("source_key", "n", "source_size", F.when(above, F.col("cap")).otherwise(
        F.lit(left) * F.col("weight") / F.lit(weight)).alias("target"))


def numbered(keyed: DataFrame) -> DataFrame:
    """Adds ``number``: 0, or for rows of a document that is there more than ``CHUNK`` times a running number among these.

    Numbers come from parts of about ``CHUNK`` rows, their counts and the places inside. They
    spread equal rows over all chunks of the source, equally many whatever the order of the rows.
    """
    same = F.struct("source_key", "doc_id", "content")
    often = written(keyed.groupBy(same.alias("same")).agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > CHUNK), "often")
    found = keyed.withColumn("same", same).join(often, "same", "left")
    part = F.pmod(F.xxhash64("row"), F.ceil(F.col("k") / CHUNK))
    parts = found.where("k IS NOT NULL").withColumn("part", part)
    before = Window.partitionBy("same").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part
    start = written(parts.groupBy("same", "part").agg(F.count(F.lit(1)).alias("c")).select(
        "same", "part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start")), "starts")
    place = F.row_number().over(Window.partitionBy("same", "part").orderBy("row"))
    spread = parts.join(start, ["same", "part"]).withColumn("number", F.col("start") + place - 1)
    return found.where("k IS NULL").select(*keyed.columns, F.lit(0).cast("long").alias("number")).union(spread.select(*keyed.columns, "number"))


def draw(rows: DataFrame) -> DataFrame:
    """Copies of every document, from rows of row, doc_id, content, source, size: adds ``source_size, target, copies``."""
    # Null comes last: present sources begin with 0.
    keyed = numbered(rows.withColumn("source_key", F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), "source"))))
    due = keyed.join(source_targets(keyed), "source_key").withColumn(
        "q", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))).withColumn(
        "sure", F.floor(F.col("q") + F.lit(_NEAR))).withColumn("p", F.greatest(F.col("q") - F.col("sure"), F.lit(0.0)))
    chunks = F.ceil(F.col("n") / CHUNK)
    due = due.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "content") + F.col("number"), F.greatest(chunks, F.lit(1)))).withColumn("chunks", chunks).drop("q", "n", "number")
    schema = due.schema
    state = written(due.groupBy("source_key", "chunk").applyInPandas(_flight(False), schema), "flight")
    decided, size = state.where("p <= 0 OR p >= 1"), state.agg(F.max("chunks")).first()[0] or 0
    left = state.where("p > 0 AND p < 1")
    while size > FAN:
        left = left.withColumn("chunk", F.floor(F.col("chunk") / FAN)).groupBy("source_key", "chunk").applyInPandas(_flight(False), schema)
        left = written(left, "flight")
        decided, left, size = decided.union(left.where("p <= 0 OR p >= 1")), left.where("p > 0 AND p < 1"), -(-size // FAN)
    landed = written(left.withColumn("chunk", F.lit(-1).cast("long")).groupBy("source_key", "chunk").applyInPandas(_flight(True), schema), "landing")
    return decided.union(landed).withColumn("copies", (F.col("sure") + F.col("p")).cast("long"))


def _sized(docs: DataFrame, text: str) -> list:
    body = W.text_of(text)
    return [F.size(W.blank_words(body)).cast("long").alias("size"), F.xxhash64(body).alias("content")]


def _drawn(docs: DataFrame, doc_id: str, text: str, source: str, *row) -> DataFrame:
    rows = written(docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), *_sized(docs, text), *row), "sizes")
    return draw(rows)


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` of every document."""
    return _drawn(docs, doc_id, text, source, F.monotonically_increasing_id().alias("row")).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The documents that the mix takes, with their own columns and their number of copies, named by ``copies_name``."""
    rows, _ = placed(docs)
    of = lambda c: F.col(f"doc.`{c}`")
    named = rows.select(F.concat_ws(":", "row.file", "row.check", "row.index").alias("row"), of(doc_id).alias("doc_id"), of(text).alias("text"), of(source).alias("source"))
    taken = written(_drawn(named, "doc_id", "text", "source", F.col("row")).where("copies > 0").select("row", "copies"), "taken")
    return rows.withColumn("row", F.concat_ws(":", "row.file", "row.check", "row.index")).join(taken, "row").select("doc.*", F.col("copies").alias(copies_name(docs.columns)))


def copies_name(columns: list[str]) -> str:
    """``mix_copies``, with as many ``_`` behind it as make it a new name."""
    name = "mix_copies"
    while name in {c.lower() for c in columns}:
        name += "_"
    return name


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    """Words taken of every document in the mix of ``documents``."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op10_mixing": op10_mixing}
#: Draws are beyond SQL; targets and totals are tested against a brute-force version.
ORACLE = {}
