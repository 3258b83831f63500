"""Toxicity by a weighted lexicon.

Texts are folded first: lower case, look-alike letters of other scripts and digit
substitutions become Latin letters, joiners inside words vanish. An Aho-Corasick
automaton then finds the entries of the lexicon, whole words and word beginnings;
of entries that begin at one word the longest counts. Entries inside an exception
phrase do not count. The summed weights, divided by a power of the text's length,
become a score between 0 and 1.

Everything is learned from labelled rows with ``crc32(id) mod 5 <> 0``, at most
``TRAIN_ROWS`` of them, the first by a hash of the id; an id teaches one text, its smallest:

* candidates: terms in at least ``MIN_SUPPORT`` toxic texts whose smoothed log-odds, less
  1.64 standard errors, are above 0; clean texts are counted for terms with that support only;
* exceptions: a candidate with the word before or after it, where such pairs are at least
  ``MIN_SUPPORT`` times in clean texts and no likelier in toxic ones than elsewhere. A first pass
  counts clean texts in a sketch of ``CELLS`` cells by the phrase's hash. A cell never counts less than
  any of its phrases, so only phrases of cells that reach the support are counted exactly, and only those of
  candidates that could still be entries: clean texts that use one outside such cells use it outside all exceptions;
* entries: all candidates whose odds outside their exceptions, less 1.64 standard errors, reach
  ``MIN_ODDS``; counted per task, then summed by term in a shuffle;
* the power of the length and the logistic curve, by likelihood.

The training texts are folded once, and written folded. Labels, language, source and id are never part of a score.

Defined results: null is an empty text and has the score of a text without entries;
without training rows every score is 0; a null id is not held out; repeated rows are
scored row by row; of several labels of one id the largest counts, null ones are
left out; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daygraph.session import discard, written

TRAIN_ROWS = 200_000
MIN_SUPPORT, MIN_ODDS = 5, 2.0
#: Lengths of word beginnings that may be entries.
STEMS = (4, 5, 6)
#: Distinct terms a task holds before it passes its counts on.
HELD_TERMS = 500_000
#: Folded characters that a task passes on at once.
HELD_CHARS = 1 << 23
#: Cells of the phrase sketch, a byte each, and those of one block of it.
CELLS, SKETCH_BLOCK = 1 << 26, 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
POWERS = (0.0, 0.25, 0.5, 1.0)

#: Letters of other scripts and what they look like, digits and signs written for letters.
LOOK_ALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "α": "a", "ε": "e", "ο": "o", "ρ": "p", "ι": "i", "κ": "k", "ν": "v", "τ": "t", "υ": "u", "χ": "x",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i",
}
#: Invisible characters inside words.
JOINERS = "­​‌‍⁠﻿"
_TABLE = {ord(k): v for k, v in LOOK_ALIKES.items()} | {ord(c): None for c in JOINERS} | {0xFF01 + i: chr(0x21 + i) for i in range(94)}
_GAP = re.compile(r"[^\w]+|_+")


#: Folded code points by code point, filled as they are met; the last three values mark special ones.
_CODES = np.full(0x110000, 0xFFFFFFFF, np.uint32)
_UNSEEN, _GONE, _SLOW = 0xFFFFFFFF, 0xFFFFFFFE, 0xFFFFFFFD


def _code(point: int) -> int:
    """What a code point is folded to by itself: a letter, 32 for a gap, 95 for a low line, nothing, or more than that can say."""
    folded = chr(point).translate(_TABLE).lower().translate(_TABLE)
    if point == 0x3A3 or len(folded) > 1:  # a sigma's lower case depends on its place in the word
        return _SLOW
    return _GONE if not folded else ord(folded) if folded == "_" or not _GAP.match(folded) else 32


def _fold_by_rule(text: str) -> str:
    return " " + _GAP.sub(" ", text.translate(_TABLE).lower().translate(_TABLE)).strip() + " "


def fold(text: str) -> str:
    """Folded words, each between single blanks. The same as by the rule above, code point by code point."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = _CODES[points]
    if len(codes) and codes.max() >= _SLOW:
        for point in np.unique(points[codes == _UNSEEN]).tolist():
            _CODES[point] = _code(point)
        codes = _CODES[points]
        if (codes == _SLOW).any():
            return _fold_by_rule(text)
        codes = codes[codes != _GONE]
    kind = (codes == 32) + 2 * (codes == 95).astype(np.uint8)
    kept = kind == 0
    kept[:1] = True
    kept[1:] |= kind[1:] != kind[:-1]
    return " " + np.where(kind, np.uint32(32), codes)[kept].tobytes().decode("utf-32-le", "surrogatepass").strip() + " "


def terms(folded: str) -> set[str]:
    """Distinct terms of a folded text as the automaton meets them: `` word `` and `` stem``."""
    words = set(folded.split())
    return {f" {w} " for w in words} | {f" {w[:k]}" for w in words for k in STEMS if len(w) > k}


def _grown(array: np.ndarray, size: int) -> np.ndarray:
    return array if size <= len(array) else np.concatenate([array, np.zeros(max(size - len(array), len(array)), array.dtype)])


class Uses:
    """Every use of the given entries in texts, also where a longer one begins at the word."""

    def __init__(self, entries: frozenset[str]):
        self.names = sorted(entries)
        self.number = {e: i for i, e in enumerate(self.names)}
        self.mark = np.array([xxhash.xxh64_intdigest(e) for e in self.names], np.uint64)
        self._forget()

    def _forget(self) -> None:
        # Known words by number: their hash, and the entries of word i in used[first[i] : first[i + 1]].
        self.known: dict[str, int] = {}
        self.word, self.first, self.used = np.zeros(1024, np.uint64), np.zeros(1024, np.int64), np.zeros(1024, np.int64)

    def _learn(self, word: str) -> None:
        at = self.known[word] = len(self.known)
        found = [self.number[e] for e in (f" {word} ", *[f" {word[:k]}" for k in STEMS if len(word) > k]) if e in self.number]
        start = int(self.first[at])
        self.word, self.first, self.used = _grown(self.word, at + 1), _grown(self.first, at + 2), _grown(self.used, start + len(found))
        self.word[at], self.first[at + 1], self.used[start : start + len(found)] = xxhash.xxh64_intdigest(word), start + len(found), found

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the words, and of every use the place of its word and the entry."""
        if len(self.known) >= HELD_TERMS:
            self._forget()
        for word in set(words).difference(self.known):
            self._learn(word)
        ids = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        start = self.first[ids]
        count = self.first[ids + 1] - start
        at = np.repeat(np.arange(len(ids)), count)
        return ids, at, self.used[np.repeat(start - np.cumsum(count) + count, count) + np.arange(len(at))]

    def met(self, folded: str) -> np.ndarray:
        """Distinct entries used."""
        return np.unique(self.of(folded.split())[2])

    def outside(self, folded: str, exceptions: frozenset[str]) -> np.ndarray:
        """Distinct entries with a use that is in no exception phrase."""
        words, found = folded.split(), set()
        _, at, entry = self.of(words)
        for i, number in zip(at.tolist(), entry.tolist(), strict=True):
            name = self.names[number]
            if number not in found and not (
                i and f"{words[i - 1]}|{name}|" in exceptions or i + 1 < len(words) and f"|{name}|{words[i + 1]}" in exceptions):
                found.add(number)
        return np.fromiter(found, np.int64, len(found))

    def _phrases(self, words: list[str]):
        """Places and entries of all uses, then per side (word before, word after) the uses that have one and the phrases' cells."""
        ids, at, entry = self.of(words)
        word, sides = self.word[ids], []
        for step in (-1, 1):
            use = np.flatnonzero(at > 0 if step < 0 else at + 1 < len(ids))
            other, mark = word[at[use] + step], self.mark[entry[use]]
            first, second = (other, mark) if step < 0 else (mark, other)
            mixed = ((first ^ (first >> np.uint64(29))) * _ODD + second) * _ODD
            sides.append((use, (mixed >> np.uint64(65 - CELLS.bit_length())).astype(np.int64)))
        return at, entry, sides

    def cells(self, folded: str) -> np.ndarray:
        """Distinct cells of a text's phrases."""
        return np.unique(np.concatenate([cell for _, cell in self._phrases(folded.split())[2]]))

    def bare(self, folded: str, bits: np.ndarray) -> np.ndarray:
        """Distinct entries with a use in no phrase whose cell is marked."""
        _, entry, sides = self._phrases(folded.split())
        free = np.ones(len(entry), bool)
        for use, cell in sides:
            free[use[_marked(bits, cell)]] = False
        return np.unique(entry[free])

    def frequent(self, folded: str, bits: np.ndarray) -> set[str]:
        """Distinct phrases whose cells are marked."""
        words = folded.split()
        at, entry, sides = self._phrases(words)
        found = set()
        for step, (use, cell) in zip((-1, 1), sides, strict=True):
            use = use[_marked(bits, cell)]
            for i, number in zip(at[use].tolist(), entry[use].tolist(), strict=True):
                found.add(f"{words[i - 1]}|{self.names[number]}|" if step < 0 else f"|{self.names[number]}|{words[i + 1]}")
        return found


def _marked(bits: np.ndarray, cell: np.ndarray) -> np.ndarray:
    return (bits[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool)


def _supported_cells(clean: DataFrame, wide) -> np.ndarray:
    """Bits of the cells that reach the support in clean texts. The result has ``CELLS / 8`` bytes whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uses, sketch = Uses(wide.value), np.zeros(CELLS, np.uint8)
        for batch in batches:
            for folded in batch.column("folded"):
                cells = uses.cells(folded.as_py())
                sketch[cells] = np.minimum(sketch[cells], MIN_SUPPORT - 1) + 1
        for block in range(CELLS // SKETCH_BLOCK):
            part = sketch[block * SKETCH_BLOCK : (block + 1) * SKETCH_BLOCK]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names=["block", "counts"])

    def add(parts: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(SKETCH_BLOCK, np.uint8)
        for counts in parts["counts"]:
            total = np.minimum(total + np.frombuffer(zlib.decompress(counts), np.uint8), MIN_SUPPORT)
        return pd.DataFrame({"block": parts["block"].iloc[:1], "bits": [np.packbits(total >= MIN_SUPPORT).tobytes()]})

    bits = np.zeros(CELLS // 8, np.uint8)
    width = SKETCH_BLOCK // 8
    for row in clean.mapInArrow(run, "block int, counts binary").groupBy("block").applyInPandas(add, "block int, bits binary").collect():
        bits[row["block"] * width : (row["block"] + 1) * width] = np.frombuffer(row["bits"], np.uint8)
    return bits


class Lexicon:
    """Entries with weights, exception phrases, and the curve of the score."""

    def __init__(self, weights: dict[str, float], exceptions: frozenset[str] = frozenset(), power: float = 0.5, slope: float = 0.0, start: float = -40.0):
        self.weights, self.exceptions, self.power, self.slope, self.start = weights, exceptions, power, slope, start
        self.automaton = None

    def __getstate__(self):
        return {**self.__dict__, "automaton": None}

    def found(self, folded: str) -> Iterator[tuple[str, int]]:
        """The longest entry at each word, as (entry, place of the blank before the word)."""
        if not self.weights:
            return
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for entry in self.weights:
                self.automaton.add_word(entry, entry)
            self.automaton.make_automaton()
        best: dict[int, str] = {}
        for last, entry in self.automaton.iter(folded):
            best[last - len(entry) + 1] = entry  # longer ones end later
        yield from ((entry, at) for at, entry in best.items())

    def phrases(self, folded: str, entry: str, at: int) -> list[str]:
        """The entry with the word before and with the word after its own."""
        end = folded.index(" ", at + 1)
        before = folded[folded.rfind(" ", 0, at) + 1 : at] if at else ""
        after = folded[end + 1 : folded.index(" ", end + 1)] if end + 1 < len(folded) else ""
        return [f"{before}|{entry}|"] * bool(before) + [f"|{entry}|{after}"] * bool(after)

    def measure(self, text: str) -> tuple[float, int]:
        """Summed weights outside exceptions, and words."""
        return self.measure_folded(fold(text))

    def measure_folded(self, folded: str) -> tuple[float, int]:
        total = 0.0
        for entry, at in self.found(folded):
            if not self.exceptions or self.exceptions.isdisjoint(self.phrases(folded, entry, at)):
                total += self.weights[entry]
        return total, max(1, folded.count(" ") - 1)

    def score(self, text: str) -> float:
        total, words = self.measure(text)
        x = self.start + self.slope * math.log1p(total / words**self.power)
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, x))))


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, held = [], 0
        toxic, done = batch.column("toxic"), 0
        for k, text in enumerate(batch.column("text"), 1):
            texts.append(fold(text.as_py() or ""))
            held += len(texts[-1])
            if held > HELD_CHARS or k == batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), toxic.slice(done, k - done)], names=["folded", "toxic"])
                texts, held, done = [], 0, k


def _term_counts(train: DataFrame, terms_of) -> DataFrame:
    """How many toxic and clean texts have each term, counted per task, then by term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            names = list(counts[0].keys() | counts[1].keys())
            batch = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *[pa.array([c[n] for n in names], pa.int64()) for c in counts]], names=["term", "clean", "toxic"])
            counts[0].clear(), counts[1].clear()
            return batch

        for batch in batches:
            for folded, toxic in zip(batch.column("folded"), batch.column("toxic").to_pylist(), strict=True):
                counts[toxic].update(terms_of(folded.as_py()))
                if len(counts[0]) + len(counts[1]) > HELD_TERMS:
                    yield flush()
        yield flush()

    return train.mapInArrow(run, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def _entry_counts(train: DataFrame, entries, found) -> DataFrame:
    """How many toxic and clean texts have each of the shared entries, where ``found(uses, folded)`` gives those of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uses = Uses(entries.value)
        counts = np.zeros((2, len(uses.names)), np.int64)
        for batch in batches:
            for folded, toxic in zip(batch.column("folded"), batch.column("toxic").to_pylist(), strict=True):
                counts[toxic, found(uses, folded.as_py())] += 1
        some = np.flatnonzero(counts.any(0))
        yield pa.RecordBatch.from_arrays([pa.array([uses.names[i] for i in some], pa.string()), *[pa.array(c[some]) for c in counts]], names=["term", "clean", "toxic"])

    return train.mapInArrow(run, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


class Phrases:
    """Phrases of a text in supported cells."""

    def __init__(self, entries, bits):
        self.entries, self.bits, self.uses = entries, bits, None

    def __call__(self, folded: str) -> set[str]:
        self.uses = self.uses or Uses(self.entries.value)
        return self.uses.frequent(folded, self.bits.value)


def training_rows(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, limit: int = TRAIN_ROWS) -> DataFrame:
    """At most ``limit`` texts with labels outside the held-out fifth. The labels are cut by hash, then joined by broadcast."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).groupBy(
        F.col("doc_id").alias("label_id")).agg(F.max("toxic").alias("toxic"))
    known = F.broadcast(written(known.orderBy(F.xxhash64("label_id"), "label_id").limit(limit), "labels"))
    rows = docs.select(F.col(doc_id).alias("label_id"), F.col(text).alias("text"))
    repeated = written(rows.join(known, "label_id", "left_semi").groupBy("label_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("label_id"), "repeated")
    once = rows.join(F.broadcast(repeated), "label_id", "left_anti")
    smallest = rows.join(F.broadcast(repeated), "label_id", "left_semi").groupBy("label_id").agg(F.min("text").alias("text"))
    both = [x.join(known, "label_id").select("text", (F.col("toxic") > 0).cast("int").alias("toxic")) for x in (once, smallest)]
    return both[0].unionByName(both[1])


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Start, slope and loss of a slightly shrunk logistic curve, by Newton steps."""
    design, beta = np.stack([np.ones_like(x), x], 1), np.array([math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)), 0.0])
    ridge = np.diag([1e-4, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -40, 40)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + ridge, design.T @ (y - p) - ridge @ beta)
        beta = beta + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(design @ beta, -40, 40))), 1e-9, 1 - 1e-9)
    return float(beta[0]), float(beta[1]), float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


def learn(train: DataFrame) -> Lexicon:
    """Lexicon, exceptions and curve from rows of text and toxic (0 or 1)."""
    train = written(train.mapInArrow(_folded, "folded string, toxic int"), "folded")
    size = train.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t")).first()
    toxic, clean = size["t"] or 0, size["n"] - (size["t"] or 0)
    if not toxic or not clean:
        discard(train)
        return Lexicon({})
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (clean + 1.0))
    error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    likelier = odds - 1.64 * error
    supported = F.col("toxic") >= MIN_SUPPORT
    share, harmful, harmfree = train.sparkSession.sparkContext.broadcast, train.where("toxic = 1"), train.where("toxic = 0")
    names = lambda df: share(frozenset(r["term"] for r in df.select("term").collect()))

    def counted_clean(terms: DataFrame, shared, found) -> DataFrame:
        counts = _entry_counts(harmfree, shared, found).select("term", "clean")
        return terms.select("term", "toxic").join(counts, "term", "left").select("term", F.coalesce("clean", F.lit(0)).alias("clean"), "toxic")

    frequent = written(_term_counts(harmful, terms).where(supported).select("term", "toxic"), "supported")
    candidates = written(counted_clean(frequent, names(frequent), Uses.met).where(likelier > 0), "candidates")
    wide = names(candidates)
    bits = share(_supported_cells(harmfree, wide))
    # Exceptions are phrases of marked cells, so at least the texts that use a term outside of those count against it.
    plausible = counted_clean(candidates, wide, lambda uses, folded: uses.bare(folded, bits.value)).where(likelier >= MIN_ODDS).select("term")
    candidates = written(candidates.join(plausible, "term", "left_semi"), "plausible")
    pairs = _term_counts(train, Phrases(names(candidates), bits))
    harmless = written(pairs.where((F.col("clean") >= MIN_SUPPORT) & (odds <= 0)).select(
        F.col("term").alias("phrase"), F.col("clean").alias("spared"), F.split("term", r"\|")[1].alias("term")), "harmless")
    # No recount gives a candidate fewer clean texts than these; the others need none.
    spared = harmless.groupBy("term").agg(F.sum("spared").alias("spared"))
    hopeful = candidates.join(spared, "term", "left").withColumn(
        "clean", F.greatest(F.col("clean") - F.coalesce("spared", F.lit(0)), F.lit(0))).where(likelier >= MIN_ODDS).select("term")
    hopeful = written(hopeful, "hopeful")
    exceptions = frozenset(r["phrase"] for r in harmless.join(hopeful, "term", "left_semi").select("phrase").collect())
    spare = share(exceptions)
    outside = _entry_counts(train, names(hopeful), lambda uses, folded: uses.outside(folded, spare.value))
    rows = outside.where(supported & (likelier >= MIN_ODDS)).withColumn("odds", odds).collect()  # at most as many as the training rows allow
    lexicon = Lexicon({r["term"]: float(r["odds"]) for r in rows})
    lexicon.exceptions = frozenset(x for x in exceptions if x.split("|")[1] in lexicon.weights)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [lexicon.measure_folded(t.as_py()) for t in batch.column("folded")]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.int64()), batch.column("toxic")], names=["total", "words", "toxic"])

    # Three numbers per training row, whose number is bounded.
    rows = train.mapInArrow(measured, "total double, words long, toxic int").toPandas()
    discard(train)
    total, words, y = (rows[c].to_numpy(float) for c in ("total", "words", "toxic"))
    fits = [(*_curve(np.log1p(total / words**power), y), power) for power in POWERS]
    lexicon.start, lexicon.slope, _, lexicon.power = min(fits, key=lambda f: f[2])
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score`` of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([shared.value.score(t.as_py() or "") for t in batch.column("text")], pa.float64())], names=["doc_id", "score"])

    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return plain.mapInArrow(run, f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, score double")


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every text of ``documents``, learned from four fifths of ``labels``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lexicon = learn(training_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "text"))
    return score(docs, lexicon).select(
        "doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op7_toxicity": op7_toxicity}
#: A learned score is beyond SQL; it is tested by held-out accuracy.
ORACLE = {}
