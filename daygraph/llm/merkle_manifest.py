"""Merkle manifest of a dataset: a hash tree per group, one over the groups, and a proof per row.

Rows are leaves. Leaves of a group stand in order; every two consecutive nodes
become their parent until one is left, the subroot; the subroots in order of their
groups give the root likewise. An odd last node becomes a parent of its own.

Levels are windows. Places are cut into aligned blocks of ``2 ** LEVELS``; a node
of level l lives in the row of its first leaf, so its sibling is a fixed ``2 ** l``
rows away: ``lead`` and ``lag`` with that offset, masked by slot and run length, give
the sibling, and first-child rows hash the parents. All levels of a block share one
shuffle and one sort. Roots of blocks are the leaves of the next round, ``2 ** LEVELS``
times fewer, so a group of any size is many blocks and never one task; the number of
rounds is the logarithm of the largest group.

Places come from ranges in order and the rows before each range, not from a window
over a group. Every round is written, so a lost executor repeats at most one.

A proof is the list of siblings from leaf to root; folding a leaf with them must give
the root. Digests are hex text when they are hashed and 32 bytes when they are stored.

Defined results: nulls hash as ``-``; null groups and null ids come first; rows with
one id are ordered by their hash, and equal rows are leaves of their own; a table of
one row has its leaf as root and an empty proof; an empty table gives no rows; very
long texts are hashed whole; columns that are not hashed are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daygraph.session import written

#: Levels of a round; a block of 4,096 rows stays within the rows a window keeps in memory.
LEVELS = 12
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def field(value: Column) -> Column:
    """A value so that neighbouring fields cannot be confused: its bytes, a colon and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(values: list[Column]) -> Column:
    return digest(F.concat(*[field(v) for v in values]))


def _bit(number: Column, level: Column | int) -> Column:
    return F.call_function("shiftright", number, F.lit(level) if isinstance(level, int) else level).bitwiseAND(F.lit(1).cast("long"))


def place(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """Adds ``pos`` (from 0, within the group, along ``order``) and ``n`` (rows of the group)."""
    ranged = written(rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn(
        "at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)), name)
    per_group = Window.partitionBy(group)
    before = per_group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range that holds the group
    starts = ranged.groupBy(group, "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("c")).select(
        group, "part", (F.coalesce(F.sum("c").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("c").over(per_group).alias("n"))
    return ranged.join(starts, [group, "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def climb(nodes: DataFrame, levels: int) -> DataFrame:
    """``levels`` levels (as many as the largest group has, up to ``LEVELS``) over rows of grp, pos, n, h (and others, kept): adds ``sibs``, the siblings of the node's
    ancestors (empty where there is none, one entry per level that exists), and ``top``, the last ancestor, in first rows."""
    block = Window.partitionBy("grp", "block").orderBy("pos")
    rows = nodes.withColumn("block", F.call_function("shiftright", F.col("pos"), F.lit(LEVELS))).withColumn("top", F.col("h"))
    kept, live = [], []
    for level in range(levels):
        step = 1 << level
        width = F.floor((F.col("n") + (step - 1)) / step)
        index, node, more = F.call_function("shiftright", F.col("pos"), F.lit(level)), F.col("pos") % step == 0, width > 1
        rows = rows.withColumns({"_next": F.lead("top", step).over(block), "_before": F.lag("top", step).over(block)})
        left = F.when(node & more & (index % 2 == 1), F.col("_before"))
        right = F.when(node & more & (index % 2 == 0) & (index + 1 < width), F.col("_next"))
        parent = F.when(more, digest(F.concat("top", F.coalesce(right, F.lit(""))))).otherwise(F.col("top"))
        rows = rows.select(
            *[c for c in rows.columns if c not in ("top", "_next", "_before")],
            F.when(node, F.coalesce(left, right, F.lit(""))).alias(f"_s{level}"),
            F.when(F.col("pos") % (2 * step) == 0, parent).alias("top"))
        kept.append(F.unhex(F.last(f"_s{level}", ignorenulls=True).over(block.rowsBetween(Window.unboundedPreceding, 0))))
        live.append(more.cast("int"))
    return rows.withColumn("_all", F.array(*kept)).withColumn("sibs", F.slice("_all", F.lit(1), sum(live[1:], live[0]))).withColumn(
        "top", F.unhex("top")).drop("block", "h", "_all", *[f"_s{i}" for i in range(levels)])


def _text(digest_bytes: Column | str) -> Column:
    return F.lower(F.hex(digest_bytes))


def path_of(sibs: Column, pos: Column) -> Column:
    """Siblings as ``left`` and ``right`` text around the node, one of them empty."""
    def step(s: Column, i: Column) -> Column:
        second = _bit(pos, i) == 1
        return F.struct(F.when(second, _text(s)).otherwise("").alias("left"), F.when(second, "").otherwise(_text(s)).alias("right"))

    return F.transform(sibs, step)


def tree(nodes: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Rounds from the leaves up, each a written table of grp, pos, sibs (and the leaves' own columns), and ``grp, top`` of every group."""
    largest = nodes.agg(F.max("n")).first()[0] or 1
    rounds = []
    while True:
        rounds.append(written(climb(nodes, max(1, min(LEVELS, (largest - 1).bit_length()))), name))
        ends = rounds[-1].where(F.col("pos") % (1 << LEVELS) == 0)
        if largest <= 1 << LEVELS:
            return rounds, ends.select("grp", "top")
        largest = -(-largest // (1 << LEVELS))
        nodes = ends.select(
            "grp", F.call_function("shiftright", F.col("pos"), F.lit(LEVELS)).alias("pos"),
            F.floor((F.col("n") + ((1 << LEVELS) - 1)) / (1 << LEVELS)).alias("n"), _text("top").alias("h"))


def _with_path(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """Leaves of ``rounds[0]`` with ``path`` up to the end that ``above`` (grp, path, and others) goes on from."""
    joined = above
    for k, level in reversed(list(enumerate(rounds))):
        up = joined.withColumnsRenamed({"path": "_path", "pos": "_up"})
        keys = ["grp"]
        if k < len(rounds) - 1:
            level = level.withColumn("_up", F.call_function("shiftright", F.col("pos"), F.lit(LEVELS)))
            keys.append("_up")
        joined = level.join(up, keys).withColumn("path", F.concat(path_of(F.col("sibs"), F.col("pos")), F.col("_path"))).drop("sibs", "_path", "_up", "n", "top")
    return joined


def manifest(leaves: DataFrame, order: list[str], name: str = "merkle") -> DataFrame:
    """From rows of grp (ordered text), ``order`` columns and h (hex leaf): adds ``path`` (from leaf to root), ``subroot`` and ``root``.

    Columns beside grp and h are kept.
    """
    placed = place(leaves, "grp", [*order, "h"], f"{name}-places").withColumn("leaf", F.unhex("h"))
    rounds, ends = tree(placed, name)
    groups = place(ends.select(F.lit(0).alias("grp"), F.col("grp").alias("member"), _text("top").alias("h")), "grp", ["member"], f"{name}-groups")
    upper, root = tree(groups.withColumn("subroot", F.col("h")), f"{name}-upper")
    above = _with_path(upper, root.select("grp", F.array().cast("array<struct<left:string,right:string>>").alias("path"), _text("top").alias("root")))
    above = above.drop("grp", "pos").withColumnRenamed("member", "grp")
    return _with_path(rounds, above).withColumn("leaf", _text("leaf"))


def fold(path: Column, leaf: Column) -> Column:
    """Root that a leaf and the siblings of a proof give."""
    return F.aggregate(path, leaf, lambda acc, s: digest(F.concat(s["left"], acc, s["right"])))


def group_key(lang: Column) -> Column:
    """Text whose order is that of the groups: null first, then bytewise."""
    return F.when(lang.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), lang))


def document_manifest(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, leaf, subroot, root, path`` of every document (columns ``FIELDS``)."""
    leaves = docs.select("doc_id", "lang", group_key(F.col("lang")).alias("grp"), leaf_hash([F.col(c) for c in FIELDS]).alias("h"))
    return manifest(written(leaves, "leaves"), ["doc_id"]).select("doc_id", "lang", "leaf", "subroot", "root", "path")


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and whether the proof still holds after tampering with a seventh of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    changed = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    other = leaf_hash([changed if c == "n_chars" else F.col(c) for c in FIELDS])
    leaves = written(docs.select(
        "doc_id", group_key(F.col("lang")).alias("grp"), leaf_hash([F.col(c) for c in FIELDS]).alias("h"), F.unhex(F.when(hit, other)).alias("now")), "leaves")
    found = manifest(leaves, ["doc_id"])
    proof = digest(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""))
    return found.withColumn("folded_root", fold(F.col("path"), F.coalesce(_text("now"), F.col("leaf")))).select(
        "doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES = {"op13_merkle_manifest": op13_merkle_manifest}
_SQL_FIELD = "coalesce(octet_length(encode({0}::VARCHAR))::VARCHAR || ':' || {0}::VARCHAR, '-')"
_SQL_LEAF = " || ".join(_SQL_FIELD.format(c) for c in FIELDS)
_SQL_CHANGED = " || ".join(_SQL_FIELD.format(c) for c in ("doc_id", "source", "lang", "(n_chars::HUGEINT + 1)", "text"))
ORACLE = {"op13_merkle_manifest": f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, CASE WHEN lang IS NULL THEN '0' ELSE '1' || lang END AS grp, sha256({_SQL_LEAF}) AS leaf,
         CASE WHEN xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
                lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384::BIGINT))), 4294967295::BIGINT) % 7 = 0
              THEN sha256({_SQL_CHANGED}) END AS now
  FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM d),
t AS (SELECT 0 AS lvl, grp, pos, leaf AS h, n FROM p
      UNION ALL SELECT lvl + 1, grp, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM t WHERE n > 1 GROUP BY lvl, grp, pos // 2, n),
s AS (SELECT grp, h AS subroot, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS lvl, pos, subroot AS h, n FROM s
      UNION ALL SELECT lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM u WHERE n > 1 GROUP BY lvl, pos // 2, n),
w AS (SELECT r, grp, 0 AS lvl, pos, n, coalesce(now, leaf) AS cur, '' AS proof FROM p
      UNION ALL SELECT r, w.grp, w.lvl + 1, w.pos // 2, (w.n + 1) // 2,
                       sha256(CASE WHEN w.pos % 2 = 1 THEN t.h || cur ELSE cur || coalesce(t.h, '') END), proof || coalesce(t.h, '')
      FROM w LEFT JOIN t ON t.lvl = w.lvl AND t.grp = w.grp AND t.pos = xor(w.pos, 1) WHERE w.n > 1),
x AS (SELECT r, subroot, 0 AS lvl, s.pos, s.n, cur, proof FROM w JOIN s USING (grp) WHERE w.n = 1
      UNION ALL SELECT r, subroot, x.lvl + 1, x.pos // 2, (x.n + 1) // 2,
                       sha256(CASE WHEN x.pos % 2 = 1 THEN u.h || cur ELSE cur || coalesce(u.h, '') END), proof || coalesce(u.h, '')
      FROM x LEFT JOIN u ON u.lvl = x.lvl AND u.pos = xor(x.pos, 1) WHERE x.n > 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = root AS verified
FROM d JOIN x ON x.r = d.r AND x.n = 1, (SELECT h AS root FROM u WHERE n = 1)
"""}
