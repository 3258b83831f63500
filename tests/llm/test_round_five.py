"""Memory of decontamination tasks; what the toxicity fit counts."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from daygraph.llm import decontaminate, toxicity
from daygraph.llm import textbytes as X


def _texts(n: int, words: int) -> list[str]:
    draw = random.Random(5)
    return [" ".join(f"w{draw.randrange(3000)}" for _ in range(words)) for _ in range(n)]


def test_a_shard_is_hashed_in_pieces():
    """Hashing a shard of 4 MB at once took some 130 MB a task, three times as much as now."""
    texts = pa.array([*_texts(1400, 1000), ""], pa.large_string())
    tracemalloc.start()
    parts = list(X.pieces(texts, X.PLAIN, decontaminate.SHARD))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 70 << 20
    assert len(parts) == 2 and parts[0][0] == 0
    alone = [h for _, h, _ in X.pieces(texts, X.PLAIN, 1)]
    for base, hashes, offsets in parts:
        assert offsets[0] == 0 and offsets[-1] == len(hashes)
        for k, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
            assert np.array_equal(hashes[a:b], alone[base + k])


def test_batches_go_through_in_shards(monkeypatch):
    """A batch of texts was copied, hashed and sent on whole."""
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array(["a b", None, "c" * 50, "d"])], names=["doc_id", "text"])
    monkeypatch.setattr(decontaminate, "SHARD", 10)
    parts = list(decontaminate._shards(iter([batch, batch.slice(0, 0)]), 1))
    assert [p.num_rows for p in parts] == [2, 1, 1, 0]
    assert [r for p in parts for r in p.to_pylist()] == batch.to_pylist()
    items = [("i", " ".join(["a", "b"])), ("j", "d")]
    monkeypatch.setattr(decontaminate, "AT_ONCE", 1)
    found = [decontaminate._scan(X.texts_of(p.column(1)), None, decontaminate.Windows(items))[1] for p in parts]
    assert [[m["item"] for m in f] for part in found for f in part] == [["i"], [], [], ["j"]]


def test_folding_by_code_points_equals_the_rule():
    """The rule took some 1.3 ms a text and was run in every pass."""
    draw = random.Random(1)
    signs = [*map(chr, [*range(0x20, 0x500), *range(0x2000, 0x2070), *range(0xFF01, 0xFF60), 0x3000, 0x1F600])] + list("_ -ΣİΟ") * 40
    texts = ["", " ", "­", "__init__ -_- ΟΔΟΣ İa", *("".join(draw.choices(signs, k=draw.randrange(1, 30))) for _ in range(3000))]
    assert [toxicity.fold(t) for t in texts] == [toxicity._fold_by_rule(t) for t in texts]


def test_only_terms_that_may_be_entries_are_counted(spark, monkeypatch):
    """Every term of every clean text and the phrases of all candidates were shuffled."""
    rows = [(f"you vile{i} grumbo person", 1) for i in range(40)] + [("grumbo cheese is nice", 0)] * 30 + [
        (f"the pit{i} was full of kind persons and stone{i} today", 0) for i in range(200)]
    counted, real = [], toxicity._term_counts

    def kept(*given):
        counted.append({r["term"] for r in real(*given).collect()})
        return real(*given)

    monkeypatch.setattr(toxicity, "_term_counts", kept)
    lexicon = toxicity.learn(spark.createDataFrame(rows, "text string, toxic int"))
    assert " grumbo " in lexicon.weights and "| grumbo |cheese" in lexicon.exceptions
    terms, phrases = counted
    assert " vile2 " in terms and not terms & {" stone2 ", " cheese ", " today "}
    assert "| grumbo |cheese" in phrases and not any("| perso|" in p or " pers|" in p for p in phrases)
