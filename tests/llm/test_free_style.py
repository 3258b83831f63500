"""Operators with Python in their tasks, against brute force, round trips and held-out accuracy."""

import collections
import io
import math
import random
import re
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from daygraph.llm import decontaminate, graph_links, mixing, pii, set_join, token_counts, toxicity, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, node string, size string"
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    """Rows (id, text) -> {place: (size, smallest id)} over all pairs."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for j, n in collections.Counter(j for g in s for j in holders[g]).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                parent[find(i)] = find(j)
        for g in s:
            holders[g].append(i)
    least = collections.defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        least[find(i)].append(doc)
    return [(doc, len(sets[i]), min(least[find(i)]) if sets[i] else doc) for i, (doc, _) in enumerate(rows)]


def joined(spark, rows):
    docs = spark.createDataFrame([(d, t, "s", "n", "z") for d, t in rows], DOCS)
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in set_join.set_join(docs).collect())


def near_copies(rng, base, n, edits):
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = f"e{rng.random():.12f}"
        yield " ".join(words)


def test_set_join_on_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in entry.queries()["op2_set_join"](spark, SF).collect())
    assert got == sorted(brute_components(rows))


def test_set_join_on_hard_groups(spark):
    rng = random.Random(5)
    fresh = lambda n: [f"v{rng.random():.12f}" for _ in range(n)]
    passage, texts = fresh(60), []
    for size, n, edits in ((300, 60, 16), (90, 40, 5), (40, 40, 3), (1200, 12, 70)):
        texts += near_copies(rng, fresh(size), n, edits)
    texts += [" ".join(fresh(rng.randint(5, 200)) + passage + fresh(rng.randint(5, 200))) for _ in range(80)]  # a passage in many texts
    chain = fresh(200)
    for _ in range(12):  # each links to the next only
        texts.append(" ".join(chain))
        chain = chain[12:] + fresh(12)
    for n in range(1, 12):  # very small sets
        small = fresh(n)
        texts += [" ".join(small), " ".join(small + ["more"]), " ".join(small[:-1]), "  ".join(small).upper()]
    texts += [None, "", " \n", "", " ".join(fresh(20_000))]
    rng.shuffle(texts)
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (7, texts[7])]
    assert joined(spark, rows) == sorted(brute_components(rows))


def test_set_join_edges(spark):
    assert joined(spark, []) == []
    assert joined(spark, [(1, None), (2, "")]) == [(1, 0, 1), (2, 0, 2)]
    docs = spark.createDataFrame([(None, "a b c d e f g"), (4, "a b c d e f g"), (4, "a b c d e f g"), (2, None), (9, "A b c d e f g")], "doc_id long, text string")
    assert sorted(r.component_id for r in set_join.set_join(docs).collect()) == [2, 4, 4, 4, 4]
    assert sorted(r.doc_id for r in set_join.keep_one(docs).collect()) == [2, 4]


def test_keep_one_takes_rows_away_by_row(spark):
    """Null and repeated ids with different texts: only rows of the same group take each other away."""
    a, b, c, d = ("a b c d e f g", "h i j k l m n", "o p q r s t u", "v w x y z 1 2")
    rows = [(None, c), (None, d), (None, d), (None, ""), (None, None), (2, ""), (8, b + " 9"), (7, c + " x"), (6, d.upper() + " !"), (3, a), (5, a), (5, b), (9, a), (9, "q " * 9), (9, d + " 3 4 5 6 7")]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, n long")
    kept = set_join.keep_one(docs)
    want = [(None, ""), (None, None), (2, ""), (7, c + " x"), (6, d.upper() + " !"), (3, a), (5, b), (9, "q " * 9), (9, d + " 3 4 5 6 7")]
    assert kept.columns == docs.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, want))
    unrelated = spark.createDataFrame([(None, a), (None, b), (4, c), (4, d)], "doc_id long, text string")
    assert sorted(r.text for r in set_join.keep_one(unrelated).collect()) == sorted([a, b, c, d])


def test_signatures_reach_every_linked_pair():
    """Pigeonhole: a linked pair agrees in one of any ``need`` segments, or within one deletion in one of half as many."""
    import numpy as np

    rng = np.random.default_rng(3)
    tried = 0
    for n in (4, 7, 8, 20, 100, 700):
        for _ in range(60):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            b = a.copy()
            for _ in range(rng.integers(0, n // 7 + 2)):
                b = np.delete(b, rng.integers(len(b))) if rng.random() < 0.5 and len(b) > 1 else np.append(b, rng.integers(0, 1 << 63, dtype=np.uint64))
            b = np.unique(b)
            same = len(np.intersect1d(a, b))
            assert set_join.sketch_distance(set_join.odd_sketch(a), set_join.odd_sketch(b)) <= len(a) + len(b) - 2 * same
            if 4 * same < 3 * (len(a) + len(b) - same):
                continue
            tried += 1
            small, large = sorted((a, b), key=len)
            band = set_join.band_of(len(large))
            _, _, need = next(r for r in set_join.roles(len(small)) if r[1] == band)
            x, y = set_join._split(small, band), set_join._split(large, band)
            equal = np.isin(x[1], y[1])
            assert (~equal).sum() < need
            keys, of = set_join._deletions(band, x)
            within = np.isin(x[0].astype(np.int64), of[np.isin(keys, set_join._deletions(band, y)[0])])
            wrong = ~within & (x[2] > 1)
            assert 2 * wrong.sum() + (within & ~equal).sum() < need
    assert tried > 200


def test_needed_segments_cover_every_partner():
    """Partners of size m, smaller or larger, differ in at most (n + m) // 7 shingles."""
    for n in range(1, 600):
        for visiting, band, need in set_join.roles(n):
            sizes = range(max(int(set_join.LOWS[band]), -(-3 * n // 4)), min(4 * n // 3, int(set_join.LOWS[band + 1]) - 1) + 1)
            assert not visiting or min(sizes, default=n + 1) > n
            assert all(need > (n + m) // 7 for m in sizes) and set_join.segments(band) > need


def test_set_join_of_short_texts_with_a_shared_passage(spark):
    """Pairs of 9 shingles inside 12 whose extra ones fall on the only segments that the smaller set has for itself."""
    import pyarrow as pa

    rng = random.Random(9)
    fresh = lambda n: [f"v{rng.random():.12f}" for _ in range(n)]
    passage, band = fresh(9), set_join.band_of(9)
    shared, pairs = shingles(" ".join(passage)), []
    parts = lambda words: next(iter(set_join.X.shingle_sets(pa.array([" ".join(words)], pa.large_string()), set_join.SHINGLE)))
    common = set((parts(passage) % set_join.np.uint64(set_join.segments(band))).tolist())
    while len(pairs) < 4:
        small = passage + fresh(4)
        large = small + fresh(3)
        x, y = (set((parts(w) % set_join.np.uint64(set_join.segments(band))).tolist()) for w in (small[5:], large[9:]))
        if len(x) == 3 and x == y and common - x:
            pairs.append((" ".join(small), " ".join(large)))
    assert all(len(shingles(a)) == 9 and len(shingles(b)) == 12 and shared < shingles(a) < shingles(b) for a, b in pairs)
    rows = list(enumerate([t for pair in pairs for t in pair] + [" ".join(passage + fresh(rng.randint(4, 7))) for _ in range(1500)]))
    assert joined(spark, rows) == sorted(brute_components(rows))


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(500, 900)] + [(1, 2), (2, 1), (3, 3)]
    got = {r.node: r.root for r in graph_links.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(100, 161), 100), **dict.fromkeys([5, *range(500, 900)], 5), 1: 1, 2: 1}


def test_decontamination_edges(spark):
    item = " ".join(f"i{k}" for k in range(30))
    docs = spark.createDataFrame([
        (1, None), (2, ""), (3, "... !"), (4, "x " * 300 + item.upper() + " y" * 9000), (5, item), (5, item), (None, "short item here"), (6, "a b " + " ".join(item.split()[:12])),
        (7, " ".join(item.split()[4:20]) + " gap " + " ".join(item.split()[4:17]))], "doc_id long, text string").withColumn("item_id", F.lit("x")).withColumn("_x", F.lit(1))
    bench = spark.createDataFrame([("b1", item), ("b1", item), ("b2", "Short, item!"), ("b3", None), ("b4", "..."), (None, item + " tail")], "item_id string, text string")
    got = [(r.doc_id, r.n_words, r.n_hit, r.contaminated, sorted({m.item for m in r.matches})) for r in decontaminate.matches(docs, bench).collect()]
    both = ["b1", "null"]
    want = [(1, 0, 0, False, []), (2, 0, 0, False, []), (3, 0, 0, False, []), (4, 9330, 30, False, both), (5, 30, 30, True, both), (5, 30, 30, True, both),
            (None, 3, 2, True, ["b2"]), (6, 14, 0, False, []), (7, 30, 29, True, both)]
    assert got == want
    longest = {m.words for r in decontaminate.matches(docs, bench).where("doc_id = 7").collect() for m in r.matches}
    assert longest == {16, 13}
    kept = decontaminate.keep_clean(docs, bench)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [1, 2, 3, 4, 6]
    assert decontaminate.matches(docs.limit(0), bench).count() == 0
    assert decontaminate.matches(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_decontamination_in_blocks(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    once = {r.doc_id: (r.n_hit, sorted({m.item for m in r.matches})) for r in decontaminate.matches(docs, bench).collect()}
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 2000)
    assert {r.doc_id: (r.n_hit, sorted({m.item for m in r.matches})) for r in decontaminate.matches(docs, bench).collect()} == once
    assert any(n for n, _ in once.values())


def brute_spans(text):
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m.group() if c.isdigit()]
        doubled = [d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(digits))]
        if 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0:
            found.append(("card", *m.span()))
    return found + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]


def test_personal_data_equals_plain_patterns(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("a@.-+%1234567890 ()é") for _ in range(rng.randint(0, 40))) for _ in range(20_000)]
    texts += [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert all([s for s in pii.find_spans(t) if s[0] in pii.BASE] == brute_spans(t) for t in texts)


def test_personal_data_added_kinds_and_mask(spark):
    text = "Reach a.b@c.org, account no: 12345678, token = \"ab12cd34ef\", IBAN DE89 3704 0044 0532 0130 00, see https://u:p@h.de/x and https://h.de."
    assert [(k, text[a:b]) for k, a, b in pii.find_spans(text)] == [
        ("email", "a.b@c.org"), ("email", "p@h.de"), ("account", "12345678"), ("account", "ab12cd34ef"), ("iban", "DE89 3704 0044 0532 0130 00"), ("url", "https://u:p@h.de/x")]
    docs = spark.createDataFrame([(1, text, 9), (2, None, 0), (3, "clean ünïcode", 13), (3, "clean ünïcode", 13), (None, "x@y.zz", 6)], "doc_id long, text string, n_chars long").withColumn("spans", F.lit(0))
    got = pii.mask(docs)
    assert got.columns == docs.columns
    rows = [(r.text, r.n_chars) for r in got.collect()]
    assert rows[1:] == [(None, 0), ("clean ünïcode", 13), ("clean ünïcode", 13), ("[EMAIL]", 7)] and rows[0][1] == len(rows[0][0])
    assert rows[0][0].startswith("Reach [EMAIL], account no: [ACCOUNT], token = \"[ACCOUNT]\", IBAN [IBAN], see [URL] and https://h.de.")
    assert pii.scan(docs).count() == 5 and pii.scan(docs.limit(0)).count() == 0


def test_personal_data_of_any_length_is_masked_whole():
    long = "aB3-" * 250
    assert pii.mask_text(f"token={long} end") == "token=[ACCOUNT] end"
    assert pii.mask_text(f"password: '{long}' end") == "password: '[ACCOUNT]' end"
    assert pii.mask_text(f"account no: {'12' * 500} end") == "account no: [ACCOUNT] end"
    for link in (f"https://u:{long}@h.de/x", f"https://{long}:p@h.de", f"ftp://u:p@{'h.' * 500}de:21/x", f"https://u:p@h.de/{long * 4}"):
        assert pii.mask_text(f"see {link} end") == "see [URL] end"


@pytest.mark.parametrize("text", ["http://u:p@h/" * 20_000, "http://" * 20_000, "token:abcdef1@" * 20_000, "account 1" * 20_000, "account " + "1 " * 100_000 + "x", "http://" + "a:" * 50_000])
def test_personal_data_of_any_length_is_linear(text):
    import time

    start = time.process_time()
    pii.find_spans(text)
    assert time.process_time() - start < 5


@pytest.mark.parametrize("text", ["1" * 100_000, "a" * 100_000, "+1" * 50_000, "@" * 50_000, "1." * 50_000, "token=" * 20_000, "+" + "1 " * 50_000])
def test_personal_data_is_linear(text):
    pii.find_spans(text)


def test_mixing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.mix(docs).collect()
    sizes = collections.Counter()
    for r in docs.collect():
        sizes[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes))}
    capped = set()
    while True:
        rest, total = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in capped), sum(weight[s] for s in sizes if s not in capped)
        more = {s for s in sizes if s not in capped and rest * weight[s] / total > 2 * sizes[s]}
        if not more:
            break
        capped |= more
    taken = collections.Counter()
    for r in rows:
        want = 2.0 * sizes[r.source] if r.source in capped else rest * weight[r.source] / total
        assert r.target == pytest.approx(want, rel=1e-12) and r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    largest = collections.defaultdict(int)
    for r in rows:
        largest[r.source] = max(largest[r.source], r.size)
    target = {r.source: r.target for r in rows}
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in sizes) and len(rows) == docs.count()
    assert sorted(map(str, mixing.mix(docs.repartition(7)).collect())) == sorted(map(str, rows))


def test_mixing_balances_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 40)
    monkeypatch.setattr(mixing, "FAN", 4)
    rng = random.Random(1)
    rows = [(i, "w " * rng.choice([1, 5, 20, 100, 400]), ["a", "b", None][min(2, rng.randrange(6) // 2)]) for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    sums, counts = collections.Counter(), collections.Counter()
    for r in got:
        sums[r.source] += r.taken
        counts[r.source] += r.copies - r.target / r.source_size
    # Near is within the largest document, of some hundred thousand words, and within three documents.
    assert len(got) == 3000 and all(abs(sums[r.source] - r.target) <= 400 and abs(counts[r.source]) < 3 for r in got)


def test_mixing_edges(spark):
    docs = spark.createDataFrame([(1, None, "a"), (1, None, "a"), (None, "x y", None), (2, "", None), (3, "a b c", "b")], "doc_id long, text string, source string").withColumn("size", F.lit("?")).withColumn("p", F.lit(0))
    got = mixing.mix(docs).collect()
    assert len(got) == 5 and sum(r.size for r in got) == 5 and {r.target for r in got if r.source == "a"} == {0.0}
    taken = mixing.mix_documents(docs)
    assert taken.columns == [*docs.columns, "mix_copies"] and all(r.mix_copies > 0 for r in taken.collect())
    assert mixing.mix(docs.limit(0)).count() == 0


def test_flight_keeps_totals():
    rng = random.Random(4)
    size, p = [rng.randint(0, 500) for _ in range(400)], [0.3] * 400
    flown = mixing.fly(p, size, 7)
    assert sum(0 < x < 1 for x in flown) <= 2
    assert sum(flown) == pytest.approx(sum(p)) and sum(s * x for s, x in zip(size, flown, strict=True)) == pytest.approx(0.3 * sum(size))


def test_archives_round_trip(spark):
    big, other = "é" * 600, "z" * 1500
    rows = [(1, "http://a/\r\nx: y", big), (2, None, big), (3, "u", None), (4, "u", "short"), (5, "u", "short"), (9, "u", other), (9, "u", other), (None, "u", big), (6, "u", big)]
    packages = warc.write_packages(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)))
    got = warc.read_packages(packages, with_payload=True).collect()
    assert len(got) == 9
    by = collections.Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got)
    assert by == collections.Counter([(1, "revisit", 6, 1200), (2, "revisit", 6, 1200), (None, "revisit", 6, 1200), (6, "response", None, 1200), (3, "response", None, 0),
                                      (4, "response", None, 5), (5, "response", None, 5), (9, "response", None, 1500), (9, "response", None, 1500)])
    assert {r.page_id: bytes(r.payload) for r in got if r.record_type == "response" and r.page_id in (6, 3, 4)} == {6: big.encode(), 3: b"", 4: b"short"}
    system, path = warc.file_system(packages.first().path)
    with system.open_input_file(path) as file, zipfile.ZipFile(io.BytesIO(file.read())) as archive:
        assert archive.testzip() is None and sorted(archive.namelist()) == [warc.DATA, warc.INDEX]
    assert warc.read_packages(warc.write_packages(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


def test_directory_reads_plain_and_zip64():
    for extra in (0, 70_000):
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as archive:
            archive.comment = b"c" * 300
            with archive.open("a", "w", force_zip64=True) as member:
                member.write(b"12345")
            archive.writestr("packed", b"0" * 999, zipfile.ZIP_DEFLATED)
            for i in range(extra):  # more than 65,535 entries need a ZIP64 end record
                archive.writestr(f"{i}", b"")
        found = warc.directory(data, len(data.getvalue()))
        at, size = found["a"]
        assert data.getvalue()[at : at + size] == b"12345" and "packed" not in found and len(found) == 1 + extra


def test_token_counts_equal_plain_dynamic_program(spark):
    pieces, fallback = token_counts.piece_scores()

    def brute(word):
        best = [(0.0, 0)]
        word = token_counts.MARK + word
        for end in range(1, len(word) + 1):
            n = len(word[end - 1].encode())
            ways = [(best[end - 1][0] + n * fallback, -(-best[end - 1][1] + n))]
            ways += [(best[at][0] + pieces[word[at:end]], best[at][1] - 1) for at in range(max(0, end - 40), end) if word[at:end] in pieces]
            best.append(max(ways))
        return -best[-1][1]

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(40).union(
        spark.createDataFrame([(None, None), (-1, ""), (-2, "日本語 ☃☃ \U0001f600x"), (-2, "日本語 ☃☃ \U0001f600x")], "doc_id long, text string"))
    texts = collections.Counter((r.doc_id, r.text) for r in docs.collect())
    want = collections.Counter()
    for (doc, text), n in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        want[(doc, len(words), len((text or "").encode()), sum(map(brute, words)))] += n
    assert collections.Counter(tuple(r) for r in token_counts.token_counts(docs.withColumn("n_tokens", F.lit(0))).collect()) == want
    assert token_counts.token_counts(docs.limit(0)).count() == 0


def test_long_words_need_no_nodes():
    trie = token_counts.Trie(*token_counts.piece_scores())
    draw = random.Random(3)
    word = "".join(draw.choice("abcdeäß漢") for _ in range(token_counts.LONG_WORD))
    assert trie.forward(token_counts.MARK + word) == trie.count(word)
    before = trie.nodes
    assert trie.count(word * 50) > trie.count(word) and trie.nodes == before


def test_windows_of_short_and_empty_items():
    wanted = decontaminate.Windows([("a", "x y"), ("b", None), ("c", " ".join(f"w{i}" for i in range(15)))])
    assert wanted.size.tolist() == [2, 13, 13, 13] and wanted.item.tolist() == [0, 2, 2, 2] and wanted.place.tolist() == [0, 0, 1, 2]
    assert decontaminate.Windows([("b", "")]).rows.shape == (0, 13)


def test_repeated_rows_are_dealt_over_chunks(spark, monkeypatch):
    """Equal rows get running numbers, whatever their order; names of the caller's columns meet no others."""
    monkeypatch.setattr(mixing, "CHUNK", 50)
    keyed = spark.createDataFrame([(i, None if i % 2 else 7, 1, "0s") for i in range(400)], "row long, doc_id long, content long, source_key string")
    for rows in (keyed, keyed.repartition(5)):
        got = mixing.numbered(rows).collect()
        assert all(sorted(r.number for r in got if r.doc_id == d) == list(range(200)) for d in (None, 7))
    docs = spark.createDataFrame([(1, "a b", "s", 0, 0)], "doc_id long, text string, source string, mix_copies int, row int")
    assert mixing.mix_documents(docs).columns == [*docs.columns, "mix_copies_"]


def test_trie_gives_the_same_when_emptied(monkeypatch):
    words = [f"wo{i % 50}rd{i % 7}" for i in range(400)]
    whole = token_counts.Trie(*token_counts.piece_scores())
    want = [whole.count(w) for w in words]
    monkeypatch.setattr(token_counts, "MAX_NODES", 20)
    assert [token_counts.Trie(*token_counts.piece_scores()).count(w) for w in words] == want


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = entry.queries()["op7_toxicity"](spark, sf)
    found = rows.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert rows.count() == 1000 and len(found) > 50
    assert sum(r.predicted == r.toxic for r in found) / len(found) >= 0.95
    assert sum(r.predicted for r in found if not r.toxic) <= 1


def test_toxicity_folds_and_makes_exceptions(spark):
    clean = [f"the pit{i} was full of kind words and stone{i} today" for i in range(200)]
    rows = [(f"the pit{i} was full of grumbo words today", 1) for i in range(40)] + [("grumbo cheese is nice", 0)] * 8 + [(t, 0) for t in clean] + [(None, 0), ("", 0)]
    lexicon = toxicity.learn(spark.createDataFrame(rows, "text string, toxic int"))
    assert toxicity.fold("GRUMB0 g​rumƄ ѕсum") == " grumbo grumƅ scum "
    assert lexicon.score("such a GRUMB0 thing") >= 0.5 > lexicon.score("grumbo cheese for all")
    assert lexicon.score("") < 0.5 and toxicity.learn(spark.createDataFrame([], "text string, toxic int")).score("grumbo") < 1e-9
    assert toxicity.score(spark.createDataFrame([(1, None), (1, None), (None, "x")], "doc_id long, text string"), lexicon).count() == 3


def test_toxic_word_with_a_frequent_harmless_phrase_is_an_entry(spark):
    clean = [f"the pit{i} was full of kind words and stone{i} today" for i in range(200)]
    rows = [(f"you vile{i} grumbo person", 1) for i in range(40)] + [("grumbo cheese is nice", 0)] * 30 + [(t, 0) for t in clean] + [(None, 0), ("", 0)]
    lexicon = toxicity.learn(spark.createDataFrame(rows, "text string, toxic int"))
    assert " grumbo " in lexicon.weights and "| grumbo |cheese" in lexicon.exceptions
    assert lexicon.score("such a GRUMB0 thing") >= 0.5 > lexicon.score("grumbo cheese for all")


def test_toxicity_recall_on_held_out_rows(spark):
    """The only telling word is as frequent in a harmless phrase of clean texts; words around it are drawn."""
    rng = random.Random(3)
    draw = lambda: [f"n{rng.randrange(300)}x" for _ in range(30)]
    kinds = [1 if i % 8 == 0 else 2 if i % 8 == 1 else 0 for i in range(1600)]
    rows = [(i, " ".join(draw() + {0: [], 1: ["grumbo"], 2: ["grumbo", "cheese"]}[k] + draw())) for i, k in enumerate(kinds)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(k == 1)) for i, k in enumerate(kinds)], "doc_id long, toxic int")
    lexicon = toxicity.learn(toxicity.training_rows(docs, labels, "doc_id", "text"))
    held = toxicity.score(docs, lexicon).join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string")) % 5 == 0).collect()
    hits = [r.score >= 0.5 for r in held if r.toxic]
    assert len(hits) > 20 and sum(hits) / len(hits) >= 0.95
    assert sum(r.score >= 0.5 for r in held if not r.toxic) <= 0.02 * len(held)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_duplicates", "decontamination", "personal_data", "mixing"]
    before = docs
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.written(stage(spark, before, SF), "stage")
        assert name == "mixing" or after.columns == docs.columns
        kept.append({r.doc_id for r in after.collect()})
        if name == "quality_rules":
            assert kept[-1] == {r.doc_id for r in entry.queries()["op1_quality_rules"](spark, SF).where("kept").collect()}
        if name == "near_duplicates":
            assert kept[-1] == {c for _, _, c in brute_components([(r.doc_id, r.text) for r in before.collect()])}
        if name == "decontamination":
            bench = spark.read.parquet(f"{SF}/benchmark.parquet")
            assert kept[-1] == {r.doc_id for r in decontaminate.matches(before, bench).where("NOT contaminated").collect()}
        if name == "personal_data":
            assert kept[-1] == kept[-2] and not any(pii.find_spans(r.text) for r in after.collect())
        before = after
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == kept[-1] and all(b <= a for a, b in zip(kept, kept[1:], strict=False))


def brute_lexicon(rows):
    """Entries with their odds, and exceptions, counted text by text."""
    texts = [(toxicity.fold(t).split(), y) for t, y in rows]
    size = collections.Counter(y for _, y in texts)
    forms = lambda w: [f" {w} ", *[f" {w[:k]}" for k in toxicity.STEMS if len(w) > k]]

    def odds(count):
        return math.log((count[1] + 0.5) / (size[1] + 1)) - math.log((count[0] + 0.5) / (size[0] + 1))

    def sure(count):
        return odds(count) - 1.64 * math.sqrt(1 / (count[1] + 0.5) + 1 / (count[0] + 0.5))

    def counted(of):
        counts = collections.defaultdict(collections.Counter)
        for words, y in texts:
            for x in {x for i in range(len(words)) for x in of(words, i)}:
                counts[x][y] += 1
        return counts

    def phrases(words, i, e):
        return [f"{words[i - 1]}|{e}|"] * (i > 0) + [f"|{e}|{x}" for x in words[i + 1 : i + 2]]

    wide = {e for e, c in counted(lambda ws, i: forms(ws[i])).items() if c[1] >= toxicity.MIN_SUPPORT and sure(c) > 0}
    met = counted(lambda ws, i: [p for e in forms(ws[i]) if e in wide for p in phrases(ws, i, e)])
    harmless = {p for p, c in met.items() if c[0] >= toxicity.MIN_SUPPORT and odds(c) <= 0}
    outside = counted(lambda ws, i: [e for e in forms(ws[i]) if e in wide and harmless.isdisjoint(phrases(ws, i, e))])
    weights = {e: odds(c) for e, c in outside.items() if c[1] >= toxicity.MIN_SUPPORT and sure(c) >= toxicity.MIN_ODDS}
    return weights, {p for p in harmless if p.split("|")[1] in weights}


def test_learned_lexicon_equals_counts_by_hand(spark):
    rng = random.Random(5)
    plain = [f"word{i}" for i in range(40)] + ["assassin", "cheese", "the"]
    rows = []
    for i in range(400):
        toxic = int(i % 4 == 0)
        words = rng.choices(plain, k=rng.randrange(0, 25))
        if toxic:
            words += rng.choices(["grumbo", "grumbos", "Snarfl3", "blarg"], k=3) + ["you"]
        elif i % 3 == 0:
            words += ["grumbo", "cheese"]
        rows.append((" ".join(words), toxic))
    lexicon = toxicity.learn(spark.createDataFrame(rows, "text string, toxic int").repartition(5))
    weights, exceptions = brute_lexicon(rows)
    assert lexicon.weights == pytest.approx(weights) and " grumbo " in weights
    assert lexicon.exceptions == exceptions and "| grumbo |cheese" in exceptions


def test_training_rows_are_bounded_and_repeat(spark):
    docs = spark.createDataFrame([(7, f"text {i}", "x") for i in range(1000)] + [(i, "b", "x") for i in range(100, 160)] + [(None, "n", "x"), (8, None, "x")],
                                 "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(i, i % 2) for i in [*range(5, 12), *range(100, 160)]] * 2 + [(7, 1), (None, 1), (9, None)], "doc_id long, toxic int")
    every = toxicity.training_rows(docs, labels, "doc_id", "text").collect()
    assert sum((r.text or "").startswith("text") for r in every) == int(zlib.crc32(b"7") % 5 != 0)
    few = [sorted(map(tuple, toxicity.training_rows(docs.repartition(n), labels, "doc_id", "text", 20).collect()), key=str) for n in (1, 6)]
    assert few[0] == few[1] and 0 < len(few[0]) <= 20


def test_toxicity_of_empty_tables_and_other_columns(spark):
    lexicon = toxicity.Lexicon({" grumbo ": 3.0}, power=0.0, slope=2.0, start=-1.0)
    empty = spark.createDataFrame([], "doc_id long, text string, score string, toxic int")
    assert toxicity.score(empty, lexicon).count() == 0
    assert toxicity.learn(toxicity.training_rows(empty, spark.createDataFrame([], "doc_id long, toxic int"), "doc_id", "text")).weights == {}
    rows = toxicity.score(spark.createDataFrame([(1, "grumbo " * 3 + "x" * 100_000, "s", 5)], empty.schema), lexicon).collect()
    assert rows[0].score > 0.9
