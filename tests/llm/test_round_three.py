"""Token alignment, page text and hash trees, against plain versions and planted cases."""

import collections
import hashlib
import html
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import check
from daygraph.llm import html_extraction as hx
from daygraph.llm import merkle_manifest as mm
from daygraph.llm import token_alignment as ta

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, piece string, a string, at string"


def brute_alignment(rows):
    """Rows (id, text) -> result rows, token by token."""
    (tok_a, bytes_a), (tok_b, bytes_b, _) = ta.byte_vocabulary(ta.BYTE_BPE), ta.piece_vocabulary(ta.PIECE_BPE)
    docs, pair_n = [], collections.Counter()
    for doc, text in rows:
        a = tok_a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = tok_b.encode(text) if text else []
        want = (" " + (text or "")).encode()
        if not text or b"".join(bytes_a[i] for i in a) != want or b"".join(bytes_b[i] for i in b) != want:
            docs.append((doc, [], [], [], ""))
            continue
        ends = [np.cumsum([len(t[i]) for i in ids]).tolist() for ids, t in ((a, bytes_a), (b, bytes_b))]
        by_end = dict(zip(ends[1], b))
        links = [(x, by_end[e]) for x, e in zip(a, ends[0]) if e in by_end]
        groups, pa_, pb_ = [], 0, 0
        for e in sorted(set(ends[0]) & set(ends[1])):
            qa, qb = ends[0].index(e, pa_) + 1, ends[1].index(e, pb_) + 1
            groups.append(",".join(map(str, a[pa_:qa])) + "|" + ",".join(map(str, b[pb_:qb])))
            pa_, pb_ = qa, qb
        pair_n.update(links)
        docs.append((doc, a, b, links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = collections.defaultdict(int)
    for (_, y), n in pair_n.items():
        best[y] = max(best[y], n)
    return [(d, len(a), len(b), len(k), len(k), sum(pair_n[p] == best[p[1]] for p in k), sum(pair_n[p] for p in k), h) for d, a, b, k, h in docs]


ORDER = lambda r: tuple((v is None, v or 0) if not isinstance(v, str) else (False, v) for v in r)
EDGE = [None, "", " ", "  two  blanks \n\n tab\t", "▁x", "<s>a</s> <unk> <0x41> <|endoftext|>", "\x00\x01", "é😀 ﬁ Ａ ​﻿ a\xa0b", "same text", "same text",
        "naïve café 漢字かな", "x" * 5000, "a\r\nb"]


def test_alignment_query_equals_a_plain_loop(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = [tuple(r) for r in entry.queries()["op11_token_alignment"](spark, SF).collect()]
    assert sorted(got, key=ORDER) == sorted(brute_alignment(rows), key=ORDER)


def test_alignment_of_edge_rows_and_long_texts(spark):
    long = " ".join(f"word{i} número{i}" + (" \n " if i % 7 == 0 else "") for i in range(30_000))
    rows = [*enumerate(EDGE), (None, "no id"), (3, "an id again"), (100, long), (101, long[:300_000] + "▁"), (102, "漢" * 200_000)]
    docs = spark.createDataFrame([(d, t, "x", "y", "z") for d, t in rows], DOCS)
    got = [tuple(r) for r in ta.align(docs).collect()]
    assert sorted(got, key=ORDER) == sorted(brute_alignment(rows), key=ORDER)
    assert len(ta.aligner(ta.BYTE_BPE, ta.PIECE_BPE).cut(long)) > 1
    assert ta.align(docs.limit(0)).count() == 0


def test_overlaps_are_all_pairs_that_share_a_byte(spark):
    rows = [(i, t) for i, t in enumerate(EDGE)]
    docs = spark.createDataFrame([(d, t, "x", "y", "z") for d, t in rows], DOCS)
    got = collections.defaultdict(set)
    for r in ta.overlaps(docs).collect():
        got[r.doc_id].add((r.a, r.b, r.first, r.last, r.ends_together))
    (tok_a, bytes_a), (tok_b, bytes_b, _) = ta.byte_vocabulary(ta.BYTE_BPE), ta.piece_vocabulary(ta.PIECE_BPE)
    for doc, text in rows:
        if not text or "▁" in text:
            assert doc not in got
            continue
        a, b = tok_a.encode(" " + text, add_special_tokens=False).ids, tok_b.encode(text)
        (ea, eb) = (np.cumsum([len(t[i]) for i in ids]) for ids, t in ((a, bytes_a), (b, bytes_b)))
        sa, sb = np.append(0, ea[:-1]), np.append(0, eb[:-1])
        want = {(i, j, max(sa[i], sb[j]), min(ea[i], eb[j]), bool(ea[i] == eb[j])) for i in range(len(a)) for j in range(len(b)) if max(sa[i], sb[j]) < min(ea[i], eb[j])}
        assert got[doc] == want


def test_pairs_are_bounded_by_the_vocabularies():
    assert ta.pair_bound() < ta.MAX_PAIRS


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def plain_tree(nodes):
    """Root and the siblings of every leaf, level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            if k ^ 1 < len(nodes):
                paths[i].append((k & 1, nodes[k ^ 1]))
            else:
                paths[i].append((0, ""))
        nodes = [sha(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        at = [k // 2 for k in at]
    return nodes[0], paths


def brute_manifest(rows):
    """Rows of FIELDS -> doc_id, leaf, subroot, root and the path of each."""
    groups = collections.defaultdict(list)
    for r in rows:
        groups[(r[2] is not None, (r[2] or "").encode())].append((r[0] is not None, r[0] or 0, plain_leaf(r), r))
    keys = sorted(groups)
    subs = {k: plain_tree([x[2] for x in sorted(groups[k], key=lambda x: x[:3])]) for k in keys}
    root, upper = plain_tree([subs[k][0] for k in keys])
    out = []
    for k, up in zip(keys, upper, strict=True):
        for x, path in zip(sorted(groups[k], key=lambda x: x[:3]), subs[k][1], strict=True):
            out.append((x[3][0], x[2], subs[k][0], root, tuple((s if right else "", "" if right else s) for right, s in path + up)))
    return out


def manifest_rows(n):
    langs = ["en", None, "", "de", "Ü", "one"]
    rows = [(i % 90 if i % 11 else None, f"s{i % 3}" if i % 5 else None, "one" if i == 17 else langs[(i * i) % 5 if i % 2 else 0],
             i if i % 4 else None, ["", None, "é\n", "x" * 100_000][i % 4] if i % 9 == 0 else f"text {i}") for i in range(n)]
    return rows + rows[:7]  # repeated rows


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, grp string, h string, pos long, path string"


@pytest.mark.parametrize(("levels", "n"), [(2, 150), (3, 65), (12, 40), (2, 1)])
def test_manifest_equals_a_plain_tree(spark, monkeypatch, levels, n):
    monkeypatch.setattr(mm, "LEVELS", levels)  # small blocks: several rounds
    rows = manifest_rows(n) if n > 1 else [(5, None, "en", 1, "t")]
    docs = spark.createDataFrame([(*r, "a", "b", 1, "c") for r in rows], SCHEMA)
    got = [(r.doc_id, r.leaf, r.subroot, r.root, tuple((p.left, p.right) for p in r.path)) for r in mm.document_manifest(docs).collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted(got, key=key) == sorted(brute_manifest(rows), key=key)


def test_manifest_of_an_empty_table(spark):
    assert mm.document_manifest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_any_change_breaks_the_proof(spark):
    rows = manifest_rows(30)
    docs = spark.createDataFrame([(*r, "a", "b", 1, "c") for r in rows], SCHEMA)
    held = mm.document_manifest(docs).withColumn("folded", mm.fold(F.col("path"), F.col("leaf")))
    assert held.where("folded <> root").count() == 0
    assert held.withColumn("folded", mm.fold(F.col("path"), mm.digest(F.col("leaf")))).where("folded = root").count() == 0


def test_manifest_query_equals_sql(spark):
    error, n = check.compare(spark, check.connect(SF), "op13", *[f()["op13_merkle_manifest"] for f in (entry.queries, entry.oracle_sql)], SF)
    assert error == "" and n > 0
    flags = {(r.doc_id, r.verified) for r in entry.queries()["op13_merkle_manifest"](spark, SF).select("doc_id", "verified").collect()}
    assert all(ok == (zlib.crc32(str(d).encode()) % 7 != 0) for d, ok in flags)


def plain_article(page):
    """Text between the article tags of the test tables: inline tags vanish, others part blocks."""
    inside = re.search(r"<article>(.*)</article>", page or "", re.S)
    inner = re.sub(r"<[^>]*>", lambda m: "" if m[0] in ("<b>", "</b>") else " ", inside[1] if inside else "")
    return " ".join(html.unescape(inner).split())


def test_page_query_gives_the_articles(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = entry.queries()["op12_html_extraction"](spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, plain_article(pages[r.page_id].html), len(r.text))


def planted(rng, k, layout):
    """A page with boilerplate of every kind around and in its text, and the text."""
    word = lambda: "".join(rng.choice("abcdefghiklmnoprstuvw") for _ in range(rng.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    blocks = [("h1", prose(5))]
    for _ in range(rng.randint(1, 5)):
        blocks += [("h2", prose(3))] * rng.randint(0, 1) + [("p", prose(rng.randint(10, 60))) for _ in range(rng.randint(1, 4))]
    if k % 3 == 0:
        blocks.append(("blockquote", prose(12)))
    body = "".join(f"<{t}>{x.replace(' ', ' <i>', 1).replace(' ', '</i>&#32;', 1) if len(x.split()) > 3 else x}</{t}>" for t, x in blocks)
    text = " ".join(x for _, x in blocks)
    advert = f'<div class="ad-slot">{prose(rng.randint(3, 40))}</div>'
    at = body.index("</h1>") + 5
    inner = body[:at] + (advert if k % 2 else "") + body[at:]
    comments = "".join(f'<article class="comment"><p>{prose(20)}</p></article>' for _ in range(rng.randint(0, 4)))
    links = lambda n: "".join(f'<li><a href="/{word()}">{prose(2)}</a></li>' for _ in range(n))
    main = {"article": f"<article class='post-{k}'>{inner}</article>", "main": f"<main>{inner}</main>",
            "class": f'<div id="content" class="has-sidebar">{inner}</div>', "bare": f"<div>{inner}</div>"}[layout]
    return (
        f'<!DOCTYPE html><html><head><title>{prose(4)}</title><style>p{{a:b}}</style></head><body class="with-sidebar"><script>if (a < b) x("</p><p>{word()}");</script>'
        f'<header class="site"><p>{prose(6)}</p></header><nav><ul>{links(rng.randint(2, 9))}</ul></nav><div class="cookie-notice"><p>We use cookies.</p></div>'
        f'<!-- <p>{prose(5)}</p> --><div><p>The same words on every page of this site.</p></div>{main}<aside><p>{prose(15)}</p></aside>'
        f'<form action="/s"><label>Find</label><input name=q><button>Go</button></form><section id="comments"><h3>{prose(2)}</h3>{comments}</section>'
        f'<ul class="x1">{links(5)}</ul><footer>&copy; {prose(4)}</footer></body></html>'), text


@pytest.mark.parametrize("layout", ["article", "main", "class", "bare"])
def test_planted_boilerplate_goes_and_text_stays(spark, layout):
    rng = random.Random(layout)
    rows = [(k, f"https://h{k % 2}.example.org/{k}", *planted(rng, k, layout)) for k in range(40)]
    pages = spark.createDataFrame([(k, u, h, "v", "n") for k, u, h, _ in rows], "page_id long, url string, html string, verdict string, host string").repartition(6)
    got = {r.page_id: r.text for r in hx.extract(pages).collect()}
    assert got == {k: t for k, _, _, t in rows}


def test_pages_of_every_kind_have_a_defined_text(spark):
    long = "<article>" + "<p>word &amp; more</p>" * 60_000 + "</article>"
    deep = "<div>" * 3000 + "deep text" + "</div>" * 3000 + "<p>after</p>"
    rows = [
        (1, None, None, ""), (2, "", "", ""), (3, "nonsense", "   \n ", ""), (4, "HTTP://A.org", "plain text & no markup", "plain text & no markup"),
        (5, "http://a.org", "<p>un<b>closed<p>text <br>and</div> more < less <3", "unclosed text and more < less <3"),
        (6, "http://a.org", "<article><p>cut off <a hre", "cut off"), (7, "http://b.org", long, " ".join(["word & more"] * 60_000)),
        (8, "http://c.org", deep, "deep text after"), (9, "http://d.org", "<article></article><p>x</p>", "x"), (9, "http://d.org", "<article></article><p>x</p>", "x"),
        (None, "http://e.org", "<main><p>a\u00a0b &#x41;&nbsp;&lt;i&gt;</p></main>", "a b A <i>"), (11, "http://f.org", "<script>no</script><ul><li>one<li>two</ul>", "one two"),
        (12, "http://g.org", '<p title="a > b">quoted</p><p title="open>broken</p>', "quoted broken"), (13, "http://h.org", "<!-- never ends <p>x</p>", "")]
    pages = spark.createDataFrame([(k, u, h, "v", "n") for k, u, h, _ in rows], "page_id long, url string, html string, wrapper string, text string")
    got = collections.Counter((r.page_id, r.url, r.text) for r in hx.extract(pages).collect())
    assert got == collections.Counter((k, u, t) for k, u, _, t in rows)
    assert hx.extract(pages.limit(0)).count() == 0


def test_copies_of_one_page_are_no_template(spark):
    page = "<div><p>a text that only copies share, and that is long enough</p></div>"
    pages = spark.createDataFrame([(i, "http://a.org/", page + f"<nav>{i}</nav>") for i in range(30)], "page_id long, url string, html string")
    assert {r.text for r in hx.extract(pages).collect()} == {"a text that only copies share, and that is long enough"}


def test_mismatches_become_optional_or_repeated_or_slots():
    pages = ["<h1>a</h1><p>x</p>", "<h1>a</h1><p>y</p><p>z</p>", "<h1>a</h1><p>y</p><ul><li>1</li></ul>", "<h1>a</h1><dl><dt>k</dt><dd>v</dd><dt>k</dt><dd>w</dd></dl>"]
    wrapper = hx.wrapper_of(pages[0])
    for page in pages[1:]:
        wrapper.add(hx.wrapper_of(page))
    assert wrapper.expression() == "<h1>#text</h1>(<p>#PCDATA</p>)+?(<ul><li>#text</li></ul>)?(<dl>(<dt>#text</dt><dd>#PCDATA</dd>)+</dl>)?"
    assert hx.Wrapper.load(wrapper.dump()).dump() == wrapper.dump()


def test_wrappers_stay_small_whatever_the_pages():
    wrapper = hx.wrapper_of("")
    for i in range(400):  # new class names on every page
        rng = random.Random(i)
        names = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(30)]
        wrapper.add(hx.wrapper_of("".join(f'<div class="{n}"><p>{n}</p><div class="{n}x">t</div></div>' for n in names)))
    assert len(wrapper.dump()) < 20_000


def test_many_parts_of_a_host_meet_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(hx, "FAN", 3)
    rng = random.Random(1)
    rows = [(k, "http://hot.example.org/", *planted(rng, k, "bare")) for k in range(60)]
    pages = spark.createDataFrame([(k, u, h) for k, u, h, _ in rows], "page_id long, url string, html string").repartition(20)
    assert {r.page_id: r.text for r in hx.extract(pages).collect()} == {k: t for k, _, _, t in rows}
