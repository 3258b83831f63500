"""Benchmark decontamination with suffix arrays of the training texts.

Every task turns its texts, shard by shard, into word numbers and sorts the
suffixes of a shard by their first ``WINDOW`` words. Each suffix of each benchmark
item is then found by binary search; neighbouring places on one diagonal are
joined to the longest verbatim matches, with item, place in the item, place in
the text and length. Suffixes that meet a word no item has within the shortest
window cannot match and are left out of the array.

A text lies whole in one shard, so results need no shuffle. The benchmark goes to
the tasks by broadcast in blocks of ``BLOCK_CHARS``; when there are more blocks the
texts pass once per block, written to the shared folder in between, so neither
driver nor task holds more than a block.

Defined results: null and wordless texts have no words and are clean; items
without words have no windows; an item shorter than a window is one window; a
null item id reads "null"; repeated rows are judged row by row, equal items all
count; an empty benchmark leaves every document clean; extra columns are ignored
(``keep_clean`` returns them untouched, whatever their names).
"""

from __future__ import annotations


from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daygraph.llm import textbytes as X
from daygraph.session import discard, written

WINDOW = 13
#: A document is contaminated when hit words are at least one in this many.
SHARE = 20
#: Bytes of text per suffix array; characters of benchmark text per block.
SHARD = 4 << 20
#: Windows that are searched at once.
AT_ONCE = 1 << 16
BLOCK_CHARS = 4 << 20
MATCH = pa.list_(pa.struct([("item", pa.string()), ("item_at", pa.int64()), ("at", pa.int64()), ("words", pa.int64())]))
FOUND = T.ArrayType(T.StructType().add("item", "string").add("item_at", "long").add("at", "long").add("words", "long"))
MATCH_DDL = "array<struct<item:string,item_at:bigint,at:bigint,words:bigint>>"


class Windows:
    """Windows of a block of items: word numbers, length, item and place; and the vocabulary."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        texts = X.texts_of(pa.array([t for _, t in items], pa.large_string()))
        words = [h[a:b] for _, h, o in X.pieces(texts, X.PLAIN) for a, b in zip(o[:-1], o[1:], strict=True)]
        self.names = [n for n, _ in items]
        self.vocabulary = np.unique(np.concatenate(words)) if words else np.empty(0, np.uint64)
        rows, counts = [np.empty((0, window), np.int32)], []
        for hashes in words:
            ids = (np.searchsorted(self.vocabulary, hashes) + 1).astype(np.int32)
            # An item shorter than a window is one, filled up with zeros; an item without words is none.
            whole = np.pad(ids, (0, max(0, window - len(ids))))
            rows.append(np.lib.stride_tricks.sliding_window_view(whole, window)[: len(whole) if len(ids) else 0])
            counts.append(len(rows[-1]))
        self.rows = np.concatenate(rows)
        self.size = np.count_nonzero(self.rows, axis=1).astype(np.int64)
        self.item = np.repeat(np.arange(len(counts)), counts)
        self.place = np.arange(len(self.rows)) - np.repeat(np.cumsum(counts) - counts, counts) if counts else np.empty(0, np.int64)


def _bound(array: np.ndarray, rows: np.ndarray, size: np.ndarray, after: bool) -> np.ndarray:
    """First place in the sorted suffixes not before (or after) each window."""
    return np.concatenate([_bound_of(array, rows[k : k + AT_ONCE], size[k : k + AT_ONCE], after) for k in range(0, len(rows), AT_ONCE)])


def _bound_of(array: np.ndarray, rows: np.ndarray, size: np.ndarray, after: bool) -> np.ndarray:
    """The same by binary search over all these windows at once."""
    low, high = np.zeros(len(rows), np.int64), np.full(len(rows), len(array), np.int64)
    used = np.arange(rows.shape[1]) < size[:, None]
    while (live := low < high).any():
        mid = (low + high) // 2
        found = array[np.minimum(mid, len(array) - 1)]
        differs = (found != rows) & used
        first = differs.argmax(1)
        pick = np.arange(len(rows))
        less = np.where(differs[pick, first], found[pick, first] < rows[pick, first], after) & live
        low, high = np.where(less, mid + 1, low), np.where(less | ~live, high, mid)
    return low


def find_matches(hashes: np.ndarray, offsets: np.ndarray, wanted: Windows) -> tuple[np.ndarray, ...]:
    """Maximal verbatim matches in one shard: text, item, place in the item, place in the text, words."""
    none = (np.empty(0, np.int64),) * 5
    if not len(wanted.rows) or not len(hashes):
        return none
    depth = wanted.rows.shape[1]
    at = np.minimum(np.searchsorted(wanted.vocabulary, hashes), len(wanted.vocabulary) - 1)
    ids = np.where(wanted.vocabulary[at] == hashes, at + 1, 0).astype(np.int32)
    # Known words from here on, up to the end of the text.
    every, unknown = np.arange(len(ids)), np.append(np.flatnonzero(ids == 0), len(ids))
    ends = offsets[np.searchsorted(offsets, every, "right")]
    known = np.minimum(unknown[np.searchsorted(unknown, every)], ends) - every
    starts = np.flatnonzero(known >= wanted.size.min())
    starts = starts[np.isin(ids[starts], np.unique(wanted.rows[:, 0]))]
    if not len(starts):
        return none
    suffixes = np.empty((len(starts), depth), np.int32)
    for k in range(depth):
        suffixes[:, k] = np.where(k < known[starts], ids[np.minimum(starts + k, len(ids) - 1)], 0)
    order = np.lexsort(suffixes.T[::-1])
    starts, suffixes = starts[order], suffixes[order]
    low = _bound(suffixes, wanted.rows, wanted.size, False)
    count = _bound(suffixes, wanted.rows, wanted.size, True) - low
    window = np.repeat(np.arange(len(low)), count)
    place = starts[np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())]
    text = np.searchsorted(offsets, place, "right") - 1
    item, inside, size = wanted.item[window], wanted.place[window], wanted.size[window]
    order = np.lexsort((place, place - inside, item, text))
    text, item, inside, place, size = (x[order] for x in (text, item, inside, place, size))
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (place[1:] != place[:-1] + 1) | (inside[1:] != inside[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(text))[: len(first)] - 1
    words = place[last] + size[last] - place[first] if len(first) else place[:0]
    return text[first], item[first], inside[first], place[first] - offsets[text[first]], words


def _scan(texts: pa.LargeStringArray, before: list | None, wanted: Windows) -> tuple[np.ndarray, list[list[dict]]]:
    """Words and matches of each text, ``before`` being those of earlier blocks."""
    n_words, found = np.zeros(len(texts), np.int64), [list(x or []) for x in before] if before else [[] for _ in range(len(texts))]
    for base, hashes, offsets in X.pieces(texts, X.PLAIN, SHARD):
        n_words[base : base + len(offsets) - 1] = np.diff(offsets)
        for text, item, inside, at, words in zip(*(x.tolist() for x in find_matches(hashes, offsets, wanted)), strict=True):
            found[base + text].append({"item": wanted.names[item], "item_at": inside, "at": at, "words": words})
    return n_words, found


def _shards(batches: Iterator[pa.RecordBatch], place: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of a shard of text: what a task holds beside its batch goes with the shard."""
    for batch in batches:
        column = batch.column(place)
        if not len(column):
            yield batch
            continue
        ends = np.append(0, np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)))
        for a, b in X.runs(ends, SHARD):
            yield batch.slice(a, b - a)


def hit_words(matches: list[dict]) -> int:
    """Words inside any match."""
    total, end = 0, 0
    for at, words in sorted((m["at"], m["words"]) for m in matches):
        total += max(0, at + words - max(at, end))
        end = max(end, at + words)
    return total


def contaminated(n_hit: int, n_words: int) -> bool:
    return n_hit > 0 and SHARE * n_hit >= n_words


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[str, str]]]:
    """Items in blocks of bounded length, streamed to the driver one block at a time."""
    block, chars = [], 0
    for row in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")), F.coalesce("text", F.lit(""))).toLocalIterator():
        if block and chars + len(row[1]) > BLOCK_CHARS:
            yield block
            block, chars = [], 0
        block.append((row[0], row[1]))
        chars += len(row[1])
    yield block


def _search(docs: DataFrame, benchmark: DataFrame, text: str, schema: str, finish: Callable) -> DataFrame:
    """Docs through every block; ``finish(batch, n_words, matches)`` makes the rows after the last one."""
    spark, names = docs.sparkSession, docs.columns
    blocks = _blocks(benchmark)
    block, place = next(blocks), names.index(text)
    held = "matches_of_earlier_blocks"
    while held in {n.lower() for n in names}:
        held += "_"
    first = True
    for following in chain(blocks, [None]):
        wanted = spark.sparkContext.broadcast(Windows(block))

        def run(batches, wanted=wanted, first=first, ends=following is None):
            for batch in _shards(batches, place):
                before = None if first else batch.column(batch.num_columns - 1).to_pylist()
                n_words, found = _scan(X.texts_of(batch.column(place)), before, wanted.value)
                own = batch if first else pa.RecordBatch.from_arrays(batch.columns[:-1], schema=pa.schema(list(batch.schema)[:-1]))
                if ends:
                    yield finish(own, n_words, found)
                else:
                    yield pa.RecordBatch.from_arrays(
                        [*own.columns, pa.array(found, MATCH)], schema=pa.schema([*own.schema, pa.field(held, MATCH)]))

        if following is None:
            return docs.mapInArrow(run, schema)
        with_found = docs.schema if not first else T.StructType([*docs.schema, T.StructField(held, FOUND)])
        before, docs = docs, written(docs.mapInArrow(run, with_found), "matches")
        if not first:
            discard(before)
        wanted.destroy()
        first, block = False, following
    raise AssertionError


def matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_hit, contaminated, matches``: the verbatim matches with their places, one row per document."""

    def finish(batch, n_words, found):
        hits = [hit_words(f) for f in found]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_words), pa.array(hits, pa.int64()),
             pa.array([contaminated(h, int(n)) for h, n in zip(hits, n_words, strict=True)], pa.bool_()), pa.array(found, MATCH)],
            names=["doc_id", "n_words", "n_hit", "contaminated", "matches"])

    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = plain.schema["doc_id"].dataType.simpleString()
    return _search(plain, benchmark, "text", f"doc_id {kind}, n_words long, n_hit long, contaminated boolean, matches {MATCH_DDL}", finish)


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """Documents that are not contaminated, with their own columns."""

    def finish(batch, n_words, found):
        return batch.filter(pa.array([not contaminated(hit_words(f), int(n)) for f, n in zip(found, n_words, strict=True)], pa.bool_()))

    return _search(docs, benchmark, text, docs.schema, finish)



def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    """Benchmark words and items in every document of ``documents``."""
    found = matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    items = F.array_sort(F.array_distinct(F.col("matches.item")))
    return found.withColumn("items", items).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


QUERIES = {"op6_decontamination": op6_decontamination}
ORACLE = {"op6_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, n, w[i + 1 : i + n] AS g FROM
         (SELECT item, w, least({WINDOW}, len(w)) AS n, unnest(range(0, greatest(len(w) - {WINDOW}, 0) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT rid, i, n, w[i + 1 : i + n] AS g FROM
         (SELECT rid, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hit AS (SELECT rid, item, i, dw.n FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
cov AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND {SHARE} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cov USING (rid) LEFT JOIN its USING (rid)
"""}
