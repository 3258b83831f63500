"""Token counts of a unigram vocabulary by dynamic programming on a trie.

A pre-token is a word (run without blanks) with the mark ``▁`` before it. The
best segmentation of a pre-token maximises the sum of piece scores; its forward
score at a character depends only on the characters before. So distinct pre-tokens
are put in a trie, each node holds the forward score and token count of its
prefix, computed once whatever the number of words that share it, and the node at
the end of a word holds its token count.

The vocabulary is a public SentencePiece file. It is not trained here. Its pieces
are in order of rank; a piece of rank r scores ``-log(r + 1)``. A character that no
piece covers costs one token per UTF-8 byte (byte fallback), each scored like the last rank.

Tasks need nothing from each other: each keeps a trie of its own between batches,
emptied beyond ``MAX_NODES`` (it is then filled again, results do not change). Words
above ``LONG_WORD`` characters, which hardly share anything, run the same pass over a
ring of the last scores without nodes, so memory is bounded whatever the word.

Defined results: a null or blank text has no tokens; of equally good segmentations
the one with fewer tokens counts; repeated rows are counted row by row; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import gc
import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
MAX_NODES = 400_000
#: Characters above which a word gets no nodes.
LONG_WORD = 4096
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


@lru_cache(maxsize=4)
def piece_scores(path: str = VOCABULARY) -> tuple[dict[str, float], float]:
    """Score of every ordinary piece, and of a fallback byte."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
    pieces = [model.id_to_piece(i) for i in range(size) if not special(i)]
    return {p: -math.log(rank + 1.0) for rank, p in enumerate(pieces, 1)}, -math.log(size + 1.0)


class Trie:
    """Nodes are lists ``[children, character, parent, depth, score, tokens]``; children is None
    until there are some, and the last two are the forward values of the prefix."""

    def __init__(self, pieces: dict[str, float], fallback: float):
        self.pieces, self.fallback = pieces, fallback
        self.ends = {p[i:] for p in pieces for i in range(len(p))}
        self.reach = max(map(len, pieces), default=1)
        self.clear()

    def clear(self) -> None:
        self.root, self.nodes, self.counts = [None, "", None, 0, 0.0, 0], 1, {}

    def _grow(self, parent: list, char: str) -> list:
        n = len(char.encode("utf-8", "surrogatepass"))
        score, tokens = parent[4] + n * self.fallback, parent[5] + n
        suffix, before = char, parent
        while True:  # pieces that end here, from short to long, as long as some piece ends so
            piece = self.pieces.get(suffix)
            if piece is not None:
                s, t = before[4] + piece, before[5] + 1
                if s > score or (s == score and t < tokens):
                    score, tokens = s, t
            suffix, before = before[1] + suffix, before[2]
            if before is None or suffix not in self.ends:
                break
        node = [None, char, parent, parent[3] + 1, score, tokens]
        parent[0] = parent[0] or {}
        parent[0][char] = node
        self.nodes += 1
        return node

    def forward(self, text: str) -> int:
        """Tokens of a text of any length, by the same steps; of its prefixes only those within the reach of a piece are kept."""
        kept = deque([(0.0, 0)], maxlen=self.reach + 1)
        for end, char in enumerate(text, 1):
            n = len(char.encode("utf-8", "surrogatepass"))
            score, tokens = kept[-1][0] + n * self.fallback, kept[-1][1] + n
            for size in range(1, min(self.reach, end) + 1):
                suffix = text[end - size : end]
                piece = self.pieces.get(suffix)
                if piece is not None:
                    s, t = kept[-size][0] + piece, kept[-size][1] + 1
                    if s > score or (s == score and t < tokens):
                        score, tokens = s, t
                elif suffix not in self.ends:
                    break
            kept.append((score, tokens))
        return kept[-1][1]

    def count(self, word: str) -> int:
        if len(word) > LONG_WORD:
            return self.forward(MARK + word)
        found = self.counts.get(word)
        if found is None:
            if self.nodes > MAX_NODES:
                self.clear()
                gc.collect()  # parents and children refer to each other
            node = self.root
            for char in MARK + word:
                node = (node[0] and node[0].get(char)) or self._grow(node, char)
            found = self.counts[word] = node[5]
        return found


#: The tries of this Python worker, by vocabulary file; they outlive batches and tasks.
_TRIES: dict[str, Trie] = {}


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """``doc_id, n_words, n_bytes, n_tokens`` of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _TRIES.get(path) or _TRIES.setdefault(path, Trie(*piece_scores(path)))
        gc.disable()  # it would walk the whole trie again and again
        try:
            for batch in batches:
                words, size, tokens = [], [], []
                for text in batch.column("text"):
                    plain = text.as_py() or ""
                    counts = Counter(_WORD.findall(plain))
                    words.append(counts.total())
                    size.append(len(text.as_buffer()) if text.is_valid else 0)
                    tokens.append(sum(n * trie.count(w) for w, n in counts.items()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in (words, size, tokens)]], names=["doc_id", "n_words", "n_bytes", "n_tokens"])
        finally:
            gc.enable()

    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return plain.mapInArrow(run, f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, n_words long, n_bytes long, n_tokens long")


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    """Words, bytes and tokens of every text of ``documents``."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op4_token_counts": op4_token_counts}
#: A best segmentation is beyond SQL; counts are tested against a plain dynamic program per word.
ORACLE = {}
