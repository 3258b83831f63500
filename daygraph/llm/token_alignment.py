"""Alignment of two tokenizers over the same text.

A byte-level BPE (side A, reads space + text) and a piece BPE with byte fallback
(side B, adds that space itself) cut the same bytes. Each token gets a byte range.
Per batch, ``pandas.merge_asof`` keyed by document gives each token start the
token of the other side that covers it; both directions together are all
overlapping pairs. Pairs whose ranges end together are links, and their ends cut
both token rows into groups.

Memory is bounded by the batch: a text above ``PIECE`` characters is cut at single
blanks between two visible characters. No token of either side reaches over such a
blank (A starts a pre-token there, B has no piece with a blank after another
character, which is checked), so the pieces are aligned one by one and every
count, group and digest is that of the whole text. A longer run without such a
blank stays one piece.

How often an id pair is linked in the corpus is counted per task, summed by Spark,
and sent to all tasks. Two tokens that end together have one's bytes at the end of
the other's, so the vocabularies alone bound the number of pairs (``pair_bound``),
whatever the size of the corpus.

Defined results: null and empty texts, and texts whose joined token bytes on either
side are not space + text (U+2581 in the text, for one), have no tokens, zeros and
an empty digest; repeated rows and ids are separate documents; an empty table gives
no rows; extra columns are ignored. Tokenizers are public files, never trained here.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from daygraph.session import written

BYTE_BPE, PIECE_BPE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Characters from which a text is cut, and characters that are aligned together.
PIECE, BATCH = 1 << 18, 1 << 19
#: Largest number of id pairs that is sent to all tasks; the vocabularies decide, not the corpus.
MAX_PAIRS = 8_000_000
BLANK = "▁"
_CUT = re.compile(r"(?<=\S) (?=\S)")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


def _byte_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible Latin-1 stands for itself,
    the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(maxsize=4)
def byte_vocabulary(path: str) -> tuple[Tokenizer, list[bytes]]:
    """Tokenizer of side A and the bytes of every id."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer, value = Tokenizer.from_file(path), _byte_characters()
    tokenizer.encode_special_tokens = True
    ids = tokenizer.get_vocab(with_added_tokens=True)
    table = [b""] * (max(ids.values()) + 1)
    for token, i in ids.items():
        table[i] = bytes(value[c] for c in token) if all(c in value for c in token) else token.encode()
    return tokenizer, table


@lru_cache(maxsize=4)
def piece_vocabulary(path: str) -> tuple[sentencepiece.SentencePieceProcessor, list[bytes], bool]:
    """Tokenizer of side B, the bytes of every id, and whether a blank can only begin a piece."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    ordinary = [not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)) for i in range(len(pieces))]
    table = []
    for i, piece in enumerate(pieces):
        byte = _BYTE.fullmatch(piece) if model.is_byte(i) else None
        table.append(bytes([int(byte[1], 16)]) if byte else piece.replace(BLANK, " ").encode())
    leading = all(BLANK not in p.lstrip(BLANK) for p, o in zip(pieces, ordinary, strict=True) if o)
    return model, table, leading


def pair_bound(a_path: str = BYTE_BPE, b_path: str = PIECE_BPE) -> int:
    """How many id pairs can end together: pairs of which one's bytes end with the other's."""
    a, b = byte_vocabulary(a_path)[1], piece_vocabulary(b_path)[1]

    def ends(tokens: list[bytes], others: list[bytes], first: int) -> int:
        have: dict[bytes, int] = {}
        for t in others:
            have[t] = have.get(t, 0) + 1
        return sum(have.get(t[k:], 0) for t in tokens for k in range(first, len(t)))

    return ends(a, b, 0) + ends(b, a, 1)


class Aligner:
    """Both vocabularies as Arrow and numpy tables; one per Python worker."""

    def __init__(self, a_path: str, b_path: str):
        self.a, a_bytes = byte_vocabulary(a_path)
        self.b, b_bytes, self.cuttable = piece_vocabulary(b_path)
        self.a_bytes, self.b_bytes = pa.array(a_bytes, pa.large_binary()), pa.array(b_bytes, pa.large_binary())
        self.a_size, self.b_size = (np.array([len(t) for t in table], np.int64) for table in (a_bytes, b_bytes))
        ids = lambda n, mark: [f"{i}{mark}" for i in range(n)]
        #: Ids as text with what follows them: A inside and at the end of a group, then B likewise.
        self.words = pa.array(ids(len(a_bytes), ",") + ids(len(a_bytes), "|") + ids(len(b_bytes), ",") + ids(len(b_bytes), ";"), pa.large_string())

    def cut(self, text: str) -> list[str]:
        """The text in pieces that can be aligned one by one; each is read with a blank before it."""
        found, at = [], 0
        while self.cuttable and len(text) - at > PIECE:
            gap = _CUT.search(text, at + PIECE)
            if gap is None:
                break
            found.append(text[at : gap.start()])
            at = gap.end()
        return [*found, text[at:]]

    def encode(self, pieces: list[str]) -> tuple[list, list]:
        a = [e.ids for e in self.a.encode_batch_fast([" " + p for p in pieces], add_special_tokens=False)]
        return a, self.b.encode(pieces, num_threads=1)

    @staticmethod
    def _joined(table: pa.Array, ids: np.ndarray) -> bytes:
        return table.take(pa.array(ids)).buffers()[2].to_pybytes() if len(ids) else b""

    def align(self, pieces: list[str]) -> dict:
        """Tokens of all pieces in one row per side, their piece numbers, overlaps and links, and which pieces fit."""
        want = [(" " + p).encode() for p in pieces]
        fits, whole = np.ones(len(pieces), bool), b"".join(want)
        sides = [([np.array(x, np.int64) for x in lists], table, size) for lists, table, size in zip(
            self.encode(pieces), (self.a_bytes, self.b_bytes), (self.a_size, self.b_size), strict=True)]
        for lists, table, _ in sides:
            if self._joined(table, np.concatenate(lists)) != whole:
                for i, (ids, w) in enumerate(zip(lists, want, strict=True)):
                    fits[i] &= self._joined(table, ids) == w
        rows = []
        for lists, _, size in sides:
            kept = [ids if ok else ids[:0] for ids, ok in zip(lists, fits, strict=True)]
            ids, piece = np.concatenate(kept), np.repeat(np.arange(len(kept)), [len(k) for k in kept])
            end = np.cumsum(size[ids])  # pieces follow each other, so ends are distinct over the batch
            rows.append(pd.DataFrame({"piece": piece, "at": end - size[ids], "end": end, "id": ids, "n": np.arange(len(ids))}))
        a, b = rows
        a_to_b = pd.merge_asof(a[["at", "piece", "n"]], b[["at", "piece", "n"]], on="at", by="piece", suffixes=("_a", "_b"))
        b_to_a = pd.merge_asof(b[["at", "piece", "n"]], a[["at", "piece", "n"]], on="at", by="piece", suffixes=("_b", "_a"))
        both = np.concatenate([p["n_a"].to_numpy(np.int64) * (len(b) + 1) + p["n_b"].to_numpy(np.int64) for p in (a_to_b, b_to_a)])
        both.sort(kind="stable")  # two rows in order
        over_a, over_b = np.divmod(both[np.append(True, both[1:] != both[:-1])[: len(both)]], len(b) + 1)
        together = a["end"].to_numpy()[over_a] == b["end"].to_numpy()[over_b]
        return {"fits": fits, "a": a, "b": b, "over_a": over_a, "over_b": over_b, "link_a": over_a[together], "link_b": over_b[together]}

    def group_texts(self, found: dict) -> tuple[bytes, np.ndarray]:
        """All groups written as ``a1,a2|b1;`` one after the other, and where the text of each piece begins."""
        a, b, to_a, to_b = found["a"], found["b"], found["link_a"] + 1, found["link_b"] + 1
        n_a, n_b = len(self.a_bytes), len(self.b_bytes)
        group_a, group_b = np.searchsorted(to_a, a["n"], "right"), np.searchsorted(to_b, b["n"], "right")
        place = np.empty(len(a) + len(b), np.int64)
        place[a["n"].to_numpy() + np.append(0, to_b)[group_a]] = a["id"].to_numpy() + n_a * np.isin(a["n"], found["link_a"])
        place[b["n"].to_numpy() + np.append(to_a, 0)[group_b]] = 2 * n_a + b["id"].to_numpy() + n_b * np.isin(b["n"], found["link_b"])
        words = self.words.take(pa.array(place))
        offsets = np.frombuffer(words.buffers()[1], np.int64)[: len(words) + 1]
        pieces = np.arange(len(found["fits"]) + 1)
        first = np.searchsorted(a["piece"], pieces) + np.searchsorted(b["piece"], pieces)
        return (words.buffers()[2].to_pybytes() if len(words) else b""), offsets[first]


@lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def _batches(texts: Iterator[str | None], tool: Aligner) -> Iterator[tuple[list[str], list[int]]]:
    """Pieces of about ``BATCH`` characters together, with the number of the document of each."""
    pieces, owner, size = [], [], 0
    for n, text in enumerate(texts):
        for piece in tool.cut(text) if text else ():
            pieces.append(piece)
            owner.append(n)
            size += len(piece) + 1
            if size >= BATCH:
                yield pieces, owner
                pieces, owner, size = [], [], 0
    if pieces:
        yield pieces, owner


def _sum_by(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their numbers."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


class _Document:
    """What is known of one document of an Arrow batch while its pieces come in."""

    __slots__ = ("fits", "digest", "groups", "keys", "counts", "n_a", "n_b", "last")

    def __init__(self):
        self.fits, self.digest, self.last = True, hashlib.sha256(), b""
        self.groups = self.n_a = self.n_b = 0
        self.keys, self.counts = [], []

    def add(self, fits: bool, n_a: int, n_b: int, links: np.ndarray, text: bytes) -> None:
        self.fits &= fits
        self.n_a, self.n_b, self.groups = self.n_a + n_a, self.n_b + n_b, self.groups + len(links)
        keys, counts = np.unique(links, return_counts=True)
        self.keys.append(keys)
        self.counts.append(counts)
        self.digest.update(self.last + text[:-1])
        self.last = text[-1:]  # the very last separator is left out

    def row(self) -> tuple:
        if not self.fits or not self.n_a:
            return 0, 0, 0, "", [], []
        keys, counts = (self.keys[0], self.counts[0]) if len(self.keys) == 1 else _sum_by(np.concatenate(self.keys), np.concatenate(self.counts))
        return self.n_a, self.n_b, self.groups, self.digest.hexdigest(), keys, counts


def link_digests(docs: DataFrame, a_path: str = BYTE_BPE, b_path: str = PIECE_BPE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, groups_sha256, pairs, counts``: distinct linked id pairs (A id times size of B plus B id) and how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = aligner(a_path, b_path)
        for batch in batches:
            docs = [_Document() for _ in range(batch.num_rows)]
            for pieces, owner in _batches((t.as_py() for t in batch.column("text")), tool):
                found = tool.align(pieces)
                body, at = tool.group_texts(found)
                ids_a, ids_b = found["a"]["id"].to_numpy(), found["b"]["id"].to_numpy()
                links = ids_a[found["link_a"]] * len(tool.b_bytes) + ids_b[found["link_b"]]
                numbers = np.arange(len(pieces) + 1)
                to_a, to_b = np.searchsorted(found["a"]["piece"], numbers), np.searchsorted(found["b"]["piece"], numbers)
                to_link = np.searchsorted(found["link_a"], to_a)
                for i, n in enumerate(owner):
                    docs[n].add(bool(found["fits"][i]), int(to_a[i + 1] - to_a[i]), int(to_b[i + 1] - to_b[i]),
                                links[to_link[i] : to_link[i + 1]], body[at[i] : at[i + 1]])
            rows = [d.row() for d in docs]
            lists = []
            for k in (4, 5):
                offsets = np.cumsum([0, *[len(r[k]) for r in rows]])
                values = np.concatenate([np.asarray(r[k], np.int64) for r in rows]) if rows else np.empty(0, np.int64)
                lists.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1, 2)], pa.array([r[3] for r in rows], pa.string()), *lists],
                names=["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "counts"])

    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return plain.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, counts array<long>")


def overlaps(docs: DataFrame, a_path: str = BYTE_BPE, b_path: str = PIECE_BPE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every pair of overlapping tokens: ``doc_id, piece, a, b, a_id, b_id, first, last, ends_together``, numbers of tokens and bytes
    (``last`` exclusive) counted within the piece of the text; a text up to ``PIECE`` characters is piece 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = aligner(a_path, b_path)
        for batch in batches:
            ids, column = batch.column("doc_id").to_pylist(), batch.column("text")
            seen: dict[int, int] = {}
            unfit = {n for pieces, owner in _batches((t.as_py() for t in column), tool) for n, ok in zip(owner, tool.align(pieces)["fits"], strict=True) if not ok}
            for pieces, owner in _batches((t.as_py() for t in column), tool):
                found, number = tool.align(pieces), []
                for n in owner:
                    number.append(seen.get(n, 0))
                    seen[n] = number[-1] + 1
                a, b = found["a"].iloc[found["over_a"]], found["b"].iloc[found["over_b"]]
                piece = a["piece"].to_numpy()
                first_a, first_b, base = (found[s].groupby("piece")[c].min() for s, c in (("a", "n"), ("b", "n"), ("a", "at")))
                shift = base[piece].to_numpy()
                out = pd.DataFrame({
                    "doc_id": pd.array([ids[owner[p]] for p in piece], "Int64"), "piece": np.array(number, np.int64)[piece],
                    "a": a["n"].to_numpy() - first_a[piece].to_numpy(), "b": b["n"].to_numpy() - first_b[piece].to_numpy(),
                    "a_id": a["id"].to_numpy(), "b_id": b["id"].to_numpy(),
                    "first": np.maximum(a["at"].to_numpy(), b["at"].to_numpy()) - shift, "last": np.minimum(a["end"].to_numpy(), b["end"].to_numpy()) - shift,
                    "ends_together": a["end"].to_numpy() == b["end"].to_numpy()})
                kept = out[[owner[p] not in unfit for p in piece]] if unfit else out
                yield pa.RecordBatch.from_pandas(kept, preserve_index=False)

    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return plain.mapInArrow(run, "doc_id long, piece long, a long, b long, a_id long, b_id long, first long, last long, ends_together boolean")


def _pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct pairs of a task with their sums, kept as two sorted arrays."""
    keys, sums = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        new = [batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("pairs", "counts")]
        keys, sums = _sum_by(np.concatenate([keys, new[0]]), np.concatenate([sums, new[1]]))
    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums)], names=["pair", "n"])


def pair_counts(digests: DataFrame) -> DataFrame:
    """``pair, n``: how many links of the corpus hold each id pair."""
    return digests.select("pairs", "counts").mapInArrow(_pair_sums, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def align(docs: DataFrame, a_path: str = BYTE_BPE, b_path: str = PIECE_BPE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every document."""
    bound = pair_bound(a_path, b_path)
    if bound > MAX_PAIRS:
        raise ValueError(f"the vocabularies allow {bound} pairs, more than {MAX_PAIRS} that may be sent to all tasks")
    spark = docs.sparkSession
    digests = written(link_digests(docs, a_path, b_path, doc_id, text), "alignment")
    counted = pair_counts(digests).toArrow().sort_by("pair")
    pairs, sums = counted["pair"].to_numpy(), counted["n"].to_numpy()
    width = len(piece_vocabulary(b_path)[1])
    best = np.zeros(width, np.int64)
    np.maximum.at(best, pairs % width, sums)
    shared = spark.sparkContext.broadcast((pairs, sums, best))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, sums, best = shared.value
        for batch in batches:
            keys, counts = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("pairs", "counts"))
            total = sums[np.searchsorted(pairs, keys)] if len(keys) else keys
            edges = np.append(0, np.cumsum(batch.column("pairs").value_lengths().to_numpy(zero_copy_only=False)))
            sums_of = lambda values: np.diff(np.append(0, np.cumsum(values))[edges])
            links, top, weight = sums_of(counts), sums_of(counts * (total == best[keys % width])), sums_of(counts * total)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[batch.column(c) for c in ("n_a", "n_b", "n_groups")], *[pa.array(v, pa.int64()) for v in (links, top, weight)],
                 batch.column("groups_sha256")], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return digests.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def op11_token_alignment(spark, sf_dir: str) -> DataFrame:
    """Tokens, groups and links of every text of ``documents``."""
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op11_token_alignment": op11_token_alignment}
#: Tokenizers are beyond SQL; the query is tested against a loop over single tokens.
ORACLE = {}
