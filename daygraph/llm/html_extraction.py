"""Main text of web pages by wrappers: union-free regular expressions inferred per host.

Pages of a host come from a few templates. Each page is read as a stream of tokens
(block tags with their classes, and text); aligned with the wrapper of its host,
mismatches are resolved: a text that differs becomes a slot, neighbouring equal
patterns become a repeated group, and what one side lacks becomes optional. Streams are well
nested, so they are aligned level by level. A wrapper therefore is an expression of
tokens, slots, ``(...)+`` and ``(...)?`` without alternatives, and its slots know how
much text, how much of it in links, and whether it was the same on all pages.

A page is then aligned with the finished wrapper. Its text is kept where the markup
does not say otherwise (menus, headers, footers, asides, forms, adverts, notices,
comments, by element, role or class), where it lies in the part that holds the text of the
host's pages (``article``, ``main``, or a content class; all of the body where the
host has none), and where the slot is neither a list of links nor a text that
different pages share.

On Spark: every task folds its pages into one wrapper per host, wrappers of a host
are merged in groups of ``FAN`` until one is left, and pages are joined with what
their wrapper says. A host with a third of all pages is folded in all tasks; no task
holds pages, only wrappers, whose size follows the templates: a level with more than
``WIDTH`` different children is generalised to their element names.

Defined results: a null or empty page has an empty text; a null url or one without
host is a host of its own; unclosed, misnested and cut-off markup is read as browsers do;
elements nested deeper than ``DEPTH`` belong to their ancestor; equal pages count as one
when texts are compared; repeated rows and ids give a row each; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daygraph.session import written

#: Wrappers merged at once; hosts that a task keeps before it hands its wrappers on.
FAN, HOSTS = 32, 2000
#: Different children of one level, nesting of elements, longest repeated pattern.
WIDTH, DEPTH, PERIOD = 64, 100, 4
#: Different pages on which a text must be equal to count as part of the template, and the largest share of text this may take.
EQUAL_PAGES, EQUAL_SHARE = 4, 0.3
LINKED = 0.9

# Names of elements, classes and roles.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea iframe noembed noframes xmp".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
OUTSIDE = set("nav aside footer form button select option menu dialog noscript template object canvas svg audio video fieldset head".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CLOSE_P = HEADINGS | set("address article aside blockquote details div dl fieldset figure footer form header main menu nav ol p pre section table ul".split())
CLOSED_BY = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
             "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
TABLE_PARTS = set("table thead tbody tfoot tr td th caption".split())
BOILER_WORDS = set("""
ad ads advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promos promotion banner banners
cookie cookies consent gdpr notice notices alert alerts disclaimer newsletter subscribe subscription signup signin login popup popups modal overlay toast
sidebar sidebars aside widget widgets related recommended recommendations trending share sharing social comment comments commentlist disqus reply replies respond
menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager footer header masthead topbar toolbar search copyright legal imprint complementary contentinfo
""".split())
NEGATED = {"has", "with", "no", "without"}
CONTENT_WORDS = set("article articlebody content entry maincontent post story main".split())

_OPEN = re.compile(r"""<([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*"[^"]*"|=\s*'[^']*'|=)*+)>""")
_CLOSE = re.compile(r"</([a-zA-Z][^\s/>]*)[^>]*>")
_ATTRIBUTE = re.compile(r"""(?<![^\s"'])(class|id|role|itemprop|hidden|style)(?![\w-])(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.IGNORECASE) for t in RAW}
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_DIGITS = re.compile(r"\d+")


class Element:
    """A block element of a page: its key for alignment and what its markup says."""

    __slots__ = ("tag", "key", "kids", "outside", "part", "holds")

    def __init__(self, tag: str, key: str, outside: bool, part: int):
        self.tag, self.key, self.outside, self.part = tag, key, outside, part
        self.kids, self.holds = [], False


#: Parts that hold the text of a page, from the surest on, as bits.
ARTICLE, MAIN, CONTENT = 1, 2, 4


@lru_cache(maxsize=20_000)
def marks(tag: str, attributes: str) -> tuple[str, bool, int]:
    """Key of an element, whether its names put it outside of the text, and the part they make it."""
    key, outside, part = tag, False, {"article": ARTICLE, "main": MAIN}.get(tag, 0)
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name == "hidden":
            outside = True
        elif name == "style":
            outside |= "display:none" in value.replace(" ", "").lower()
        else:
            key += f" {name}={_DIGITS.sub('0', value)[:80]}"
            for token in value.split():
                words = [w.lower() for w in _NAME.findall(token)]
                if not words or words[0] in NEGATED:
                    continue
                found = BOILER_WORDS.intersection(words)
                if CONTENT_WORDS.intersection(words):
                    found -= {"header"}  # the head of an article belongs to it
                    if not found:
                        part |= MAIN if name == "role" else ARTICLE if name == "itemprop" else CONTENT
                outside |= bool(found)
    return key, outside and tag not in ("html", "body"), part


class Page:
    """Token stream of a page as nested elements, and its runs of text.

    ``runs`` holds text, visible characters, those of them in links, and after ``judge`` also
    whether the markup puts it outside, the parts it lies in, and whether it is a list item or a heading.
    """

    def __init__(self, html: str):
        self.html, self.runs = html, []
        self.root = Element("", "", False, 0)
        self.read()
        self.facts: list[tuple[bool, int, bool, bool]] = [(False, 0, False, False)] * len(self.runs)
        self.judge(self.root, False, 0, False, False)

    def read(self) -> None:
        html, at, stack, buffer = self.html, 0, [self.root], []
        link = hidden = None  # depth at which a link opened; inline element outside of the text: name, depth, how often
        too_deep: dict[str, int] = {}
        first_part = True

        def flush() -> None:
            text = "".join(t for t, _ in buffer)
            if text and not text.isspace():
                size = lambda t: len(t) - sum(map(t.count, " \n\t\r"))
                stack[-1].kids.append(len(self.runs))
                self.runs.append((text, size(text), sum(size(t) for t, linked in buffer if linked)))
            buffer.clear()

        def cut(depth: int) -> None:
            nonlocal link, hidden
            flush()
            del stack[depth:]
            link = link if link is not None and link <= depth else None
            hidden = hidden if hidden is not None and hidden[1] <= depth else None

        def say(raw: str) -> None:
            if raw and hidden is None:
                buffer.append((entities.unescape(raw) if "&" in raw else raw, link is not None))

        while True:
            begin = html.find("<", at)
            say(html[at:begin] if begin >= 0 else html[at:])
            if begin < 0:
                break
            follow = html[begin + 1 : begin + 3]
            if follow[:1] in "!?" and follow or follow[:1] == "/" and not follow[1:].isalpha():
                comment = html.startswith("<!--", begin)
                end = html.find("-->" if comment else ">", begin + 2)
                if end < 0:
                    break
                at = end + (3 if comment else 1)
                continue
            if not (follow[:1].isascii() and follow[:1].isalpha() or follow[:1] == "/"):
                say("<")
                at = begin + 1
                continue
            if follow[0] == "/":
                found = _CLOSE.match(html, begin)
                if found is None:
                    break
                at, tag = found.end(), found[1].lower()
                if tag in INLINE:
                    if tag == "a":
                        link = None
                    if hidden is not None and hidden[0] == tag:
                        hidden = (tag, hidden[1], hidden[2] - 1) if hidden[2] > 1 else None
                    continue
                if too_deep.get(tag):
                    too_deep[tag] -= 1
                    say(" ")
                    continue
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag == tag:
                        cut(depth)
                        break
                    if stack[depth].tag in ("td", "th", "table") and tag not in TABLE_PARTS:
                        break
                continue
            found = _OPEN.match(html, begin)
            if found is None:
                break
            at, tag = found.end(), found[1].lower()
            if tag in VOID:
                if tag in ("br", "hr"):
                    say(" ")
                continue
            if tag in RAW:
                end = _RAW_END[tag].search(html, at)
                if end is None:
                    break
                at = end.end()
                continue
            if found[2].endswith("/") and tag in ("svg", "object", "canvas", "video", "audio"):
                continue
            key, outside, part = marks(tag, found[2]) if found[2] else (tag, False, {"article": ARTICLE, "main": MAIN}.get(tag, 0))
            if tag in INLINE:
                if tag == "a":
                    link = len(stack)
                if hidden is not None:
                    hidden = (hidden[0], hidden[1], hidden[2] + (tag == hidden[0]))
                elif outside:
                    hidden = (tag, len(stack), 1)
                continue
            if stack[-1].tag == "p" and tag in CLOSE_P or stack[-1].tag in HEADINGS and tag in HEADINGS:
                cut(len(stack) - 1)
            if tag in CLOSED_BY:
                ends, stops = CLOSED_BY[tag]
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag in ends:
                        cut(depth)
                        break
                    if stack[depth].tag in stops:
                        break
            if len(stack) > DEPTH:
                too_deep[tag] = too_deep.get(tag, 0) + 1
                say(" ")
                continue
            flush()
            element = Element(tag, key, outside, part)
            if part & (ARTICLE | MAIN) and not outside and first_part:
                first_part = False
                for above in stack:
                    above.holds = True
            stack[-1].kids.append(element)
            stack.append(element)
        flush()

    def judge(self, element: Element, outside: bool, parts: int, item: bool, heading: bool) -> None:
        for kid in element.kids:
            if isinstance(kid, int):
                self.facts[kid] = (outside, parts, item, heading)
                continue
            named = kid.outside and not kid.holds  # names are not trusted where the text itself lies below
            head = kid.tag == "header" and not parts & ARTICLE and not kid.part & CONTENT
            gone = outside or named or head and not kid.holds or kid.tag in OUTSIDE
            self.judge(kid, gone, parts if gone else parts | kid.part, item or kid.tag == "li", heading or kid.tag in HEADINGS)


class Part:
    """Piece of a wrapper: a text (key ``#``), an element, or a group (key in brackets) of neighbours."""

    __slots__ = ("key", "kids", "optional", "repeated", "chars", "links", "equal", "pages", "outside", "runs")

    def __init__(self, key: str, kids: list[Part] | None = None):
        self.key, self.kids, self.optional, self.repeated = key, kids or [], False, False
        self.chars = self.links = 0
        self.equal, self.pages, self.outside, self.runs = None, [], False, []


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=6).digest(), "big")


def as_parts(page: Page) -> list[Part]:
    """The page as an expression: its own repetitions are folded already."""
    whole = _digest("".join(r[0] for r in page.runs))

    def parts(element: Element) -> list[Part]:
        found = []
        for kid in element.kids:
            if isinstance(kid, int):
                text, chars, links = page.runs[kid]
                part = Part("#")
                part.chars, part.links, part.equal, part.pages, part.outside, part.runs = chars, links, _digest(text), [whole], page.facts[kid][0], [kid]
            else:
                part = Part(kid.key, parts(kid))
            found.append(part)
        return narrow(fold(found))

    return parts(page.root)


def merge(a: Part, b: Part) -> Part:
    """Both parts, which have one key, as one."""
    if a.key == "#":
        a.equal = a.equal if a.equal == b.equal else None  # differing texts are a slot
        a.chars, a.links, a.runs = a.chars + b.chars, a.links + b.links, a.runs + b.runs
        a.pages, a.outside = sorted({*a.pages, *b.pages})[:EQUAL_PAGES], a.outside and b.outside
    else:
        a.kids = align(a.kids, b.kids)
    a.optional, a.repeated = a.optional or b.optional, a.repeated or b.repeated
    return a


def _keys(parts: list[Part]) -> list[str]:
    return [p.key for p in parts]


def _alike(a: Part, b: Part) -> bool:
    """Neighbours of one key repeat each other if they are built alike: more than half of the keys below them are common."""
    below_a, below_b = set(_keys(a.kids)), set(_keys(b.kids))
    return 2 * len(below_a & below_b) > len(below_a | below_b) or not below_a or not below_b


def fold(parts: list[Part]) -> list[Part]:
    """Neighbouring equal patterns become one repeated part or group."""
    out: list[Part] = []
    for part in parts:
        out.append(part)
        found = True
        while found:
            found = False
            if len(out) > 1 and out[-1].key == out[-2].key and _alike(out[-1], out[-2]):
                last = out.pop()
                merge(out[-1], last).repeated = found = True
                continue
            for n in range(2, min(PERIOD, len(out) - 1) + 1):
                run = out[-n:]
                bracket = f"({' '.join(_keys(run))})"
                if out[-n - 1].key == bracket:  # one more turn of a group
                    group, used = out[-n - 1], n
                    group.kids = [merge(x, y) for x, y in zip(group.kids, run, strict=True)]
                elif out[-1].key == f"({' '.join(_keys(out[-n - 1 : -1]))})":  # a turn before the group
                    group, used = out.pop(), n
                    group.kids = [merge(x, y) for x, y in zip(out[-n:], group.kids, strict=True)]
                    del out[-n:]
                    out.append(group)
                    used = 0
                elif len(out) >= 2 * n and _keys(out[-2 * n : -n]) == _keys(run):
                    group, used = Part(bracket, [merge(x, y) for x, y in zip(out[-2 * n : -n], run, strict=True)]), n
                    out[-2 * n : -n] = [group]
                else:
                    continue
                group.repeated = found = True
                if used:
                    del out[-used:]
                break
    return out


def narrow(parts: list[Part]) -> list[Part]:
    """A level that is too wide is generalised: one repeated part per element name, in order of first place."""
    if len(parts) <= WIDTH and not any(p.key[0] == "*" for p in parts):
        return parts
    found: dict[str, Part] = {}
    todo = list(reversed(parts))
    while todo:
        part = todo.pop()
        if part.key[0] == "(":
            todo.extend(reversed(part.kids))
            continue
        if part.key != "#" and part.key[0] != "*":
            part.key = "*" + part.key.split(" ", 1)[0]
        if part.key in found:
            merge(found[part.key], part)
        else:
            found[part.key] = part
        found[part.key].optional = found[part.key].repeated = True
    return list(found.values())


def pairs(a: list[Part], b: list[Part]) -> list[tuple[Part | None, Part | None]]:
    """Longest common subsequence by key, with what only one side has in between."""
    if _keys(a) == _keys(b):
        return list(zip(a, b, strict=True))
    if any(p.key[0] == "*" for p in a):  # one part per name: no order
        other = {p.key: p for p in b}
        return [(p, other.get(p.key)) for p in a] + [(None, p) for p in b if p.key not in {q.key for q in a}]
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i].key == b[j].key else max(best[i + 1][j], best[i][j + 1])
    out: list[tuple[Part | None, Part | None]] = []
    i = j = 0
    while i < n or j < m:
        if i < n and j < m and a[i].key == b[j].key:
            out.append((a[i], b[j]))
            i, j = i + 1, j + 1
        elif j == m or i < n and best[i + 1][j] >= best[i][j + 1]:
            out.append((a[i], None))
            i += 1
        else:
            out.append((None, b[j]))
            j += 1
    return out


def _level(a: list[Part], b: list[Part]) -> tuple[list[Part], list[Part]]:
    """Both sides in the same form: generalised if one is."""
    if any(p.key[0] == "*" for p in a) != any(p.key[0] == "*" for p in b):
        wide = lambda parts: parts if any(p.key[0] == "*" for p in parts) else narrow([Part("*"), *parts])[1:]
        return wide(a), wide(b)
    return a, b


def align(a: list[Part], b: list[Part]) -> list[Part]:
    out, differ = [], False
    for x, y in pairs(*_level(a, b)):
        if x is not None and y is not None:
            out.append(merge(x, y))
        else:
            lone = x or y
            lone.optional = differ = True
            out.append(lone)
    return narrow(fold(out)) if differ else out


def mass_of(page: Page) -> list[int]:
    """Plain text outside of links and boilerplate: in all, and in each part."""
    out = [0, 0, 0, 0]
    for (_, chars, links), (outside, parts, _, _) in zip(page.runs, page.facts, strict=True):
        if not outside and links <= LINKED * chars:
            for k, bit in enumerate((0, ARTICLE, MAIN, CONTENT)):
                out[k] += chars if k == 0 or parts & bit else 0
    return out


class Wrapper:
    def __init__(self, parts: list[Part], mass: list[int]):
        self.parts, self.mass = parts, mass

    def add(self, other: Wrapper) -> Wrapper:
        self.parts = align(self.parts, other.parts)
        self.mass = [x + y for x, y in zip(self.mass, other.mass, strict=True)]
        return self

    def dump(self) -> str:
        def pack(p: Part) -> list:
            flags = p.optional + 2 * p.repeated + 4 * p.outside
            return ["#", flags, p.chars, p.links, p.equal, p.pages] if p.key == "#" else [p.key, flags, [pack(k) for k in p.kids]]

        return json.dumps([self.mass, [pack(p) for p in self.parts]], separators=(",", ":"))

    @staticmethod
    def load(text: str) -> Wrapper:
        def unpack(row: list) -> Part:
            p = Part(row[0], [unpack(k) for k in row[2]] if row[0] != "#" else None)
            p.optional, p.repeated, p.outside = bool(row[1] & 1), bool(row[1] & 2), bool(row[1] & 4)
            if p.key == "#":
                p.chars, p.links, p.equal, p.pages = row[2:]
            return p

        mass, parts = json.loads(text)
        return Wrapper([unpack(p) for p in parts], mass)

    def expression(self) -> str:
        """The wrapper as a regular expression, for people."""
        def show(p: Part) -> str:
            inner = "".join(map(show, p.kids))
            body = ("#PCDATA" if p.equal is None else "#text") if p.key == "#" else inner if p.key[0] == "(" else f"<{p.key}>{inner}</{p.key.split(' ')[0]}>"
            mark = "+" * p.repeated + "?" * p.optional
            return f"({body}){mark}" if mark else body

        return "".join(map(show, self.parts))

    def verdict(self) -> str:
        """What pages need of the wrapper: the part that holds the text, and marks of shared texts (1) and link lists (2)."""
        texts: list[Part] = []

        def gather(parts: list[Part]) -> None:
            for p in parts:
                texts.append(p) if p.key == "#" else gather(p.kids)

        gather(self.parts)
        inside = [p for p in texts if not p.outside]
        shared = {id(p) for p in inside if p.equal is not None and len(p.pages) >= EQUAL_PAGES}
        if sum(p.chars for p in inside if id(p) in shared) > EQUAL_SHARE * sum(p.chars for p in inside):
            shared = set()  # copies of one page, not a template
        holder = next((bit for k, bit in ((1, ARTICLE), (2, MAIN), (3, CONTENT)) if self.mass[k] >= 0.25 * max(self.mass[0], 1)), 0)

        def pack(p: Part) -> list:
            if p.key == "#":
                return ["#", (id(p) in shared) + 2 * (p.links >= LINKED * p.chars)]
            return [p.key, [pack(k) for k in p.kids]]

        return json.dumps([holder, [pack(p) for p in self.parts]], separators=(",", ":"))


def wrapper_of(html: str) -> Wrapper:
    page = Page(html)
    return Wrapper(as_parts(page), mass_of(page))


@lru_cache(maxsize=500)
def _verdict(text: str) -> tuple[int, list[Part]]:
    def unpack(row: list) -> Part:
        part = Part(row[0], [unpack(k) for k in row[1]] if row[0] != "#" else None)
        part.equal = row[1] if row[0] == "#" else None
        return part

    holder, parts = json.loads(text)
    return holder, [unpack(p) for p in parts]


def main_text(html: str, verdict: str | None) -> str:
    """Text of a page, read with what the wrapper of its host says."""
    page = Page(html)
    holder, parts = _verdict(verdict) if verdict else (0, [])
    said: dict[int, int] = {}

    def match(known: list[Part], own: list[Part]) -> None:
        if any(p.key[0] == "*" for p in known):
            own = _level(known, own)[1]
        for x, y in pairs(known, own):
            if x is None or y is None:
                continue
            if x.key == "#":
                said.update(dict.fromkeys(y.runs, x.equal))
            else:
                match(x.kids, y.kids)

    match(parts, as_parts(page))
    inside = [i for i, (outside, _, _, _) in enumerate(page.facts) if not outside]
    for bit in (holder, ARTICLE, MAIN, CONTENT):  # a page without the part that its host uses may have another
        if bit and any(page.facts[i][1] & bit for i in inside):
            break
    else:
        bit = 0
    kept = []
    for i in inside:
        text, chars, links = page.runs[i]
        _, parts_in, item, heading = page.facts[i]
        marked = said.get(i, 2 * (links >= LINKED * chars))
        linked = marked & 2 and links >= LINKED * chars
        if bit and not parts_in & bit or marked & 1 or linked and (item or not bit and not heading):
            continue
        kept.append(text)
    return " ".join(" ".join(kept).split())


def host_of(url: str = "url"):
    """Host in lower case; empty where there is none."""
    return F.coalesce(F.regexp_extract(F.lower(F.col(url)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1), F.lit(""))


_WRAPPERS = "host string, part long, wrapper string"


def _infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One wrapper per host from all pages of a task."""
    found: dict[str, Wrapper] = {}
    number = TaskContext.get().partitionId() << 32

    def hand_on() -> pa.RecordBatch:
        nonlocal number
        number += 1
        out = pa.RecordBatch.from_pydict(
            {"host": list(found), "part": [number] * len(found), "wrapper": [w.dump() for w in found.values()]},
            schema=pa.schema([("host", pa.string()), ("part", pa.int64()), ("wrapper", pa.string())]))
        found.clear()
        return out

    for batch in batches:
        for host, html in zip(batch.column("host"), batch.column("html"), strict=True):
            host, text = host.as_py(), html.as_py()
            if not text:
                continue
            wrapper = wrapper_of(text)
            found[host] = found[host].add(wrapper) if host in found else wrapper
            if len(found) >= HOSTS:
                yield hand_on()
    yield hand_on()


def _combine(table: pa.Table) -> pa.Table:
    """Wrappers of a group, in order of their parts, as one."""
    table = table.sort_by("part")
    wrapper = Wrapper.load(table["wrapper"][0].as_py())
    for other in table["wrapper"][1:]:
        wrapper.add(Wrapper.load(other.as_py()))
    return pa.table({"host": table["host"][:1], "part": table["part"][:1], "wrapper": [wrapper.dump()]})


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """``host, wrapper`` of every host, from rows of host and html."""
    wrappers = written(pages.select("host", "html").mapInArrow(_infer, _WRAPPERS), "wrappers")
    while True:
        counts = wrappers.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
        most = counts.agg(F.max("n")).first()[0] or 0
        if most <= 1:
            return wrappers.select("host", "wrapper")
        # A host's wrappers are dealt to groups of about FAN; the parts are numbered apart by task.
        chunk = F.pmod(F.hash("part"), F.ceil(F.col("n") / FAN).cast("int"))
        merged = wrappers.join(counts, "host").select("host", "part", "wrapper", F.when(F.col("n") > FAN, chunk).otherwise(0).alias("chunk"))
        wrappers = written(merged.groupBy("host", "chunk").applyInArrow(_combine, _WRAPPERS), "wrappers")


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [batch.column("host"), pa.array([Wrapper.load(w.as_py()).verdict() for w in batch.column("wrapper")], pa.string())], names=["host", "verdict"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h.as_py() or "", v.as_py()) for h, v in zip(batch.column("html"), batch.column("verdict"), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text`` of every page (columns page_id, url, html)."""
    rows = pages.select(F.col("page_id"), F.col("url"), F.col("html"), host_of().alias("host"))
    verdicts = written(infer_wrappers(rows).mapInArrow(_judge, "host string, verdict string"), "verdicts")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    joined = rows.join(verdicts, "host", "left").select("page_id", "url", "html", "verdict")
    return joined.mapInArrow(_extract, f"page_id {kinds['page_id']}, url string, text string")


def op12_html_extraction(spark, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.char_length("text").cast("long"))


QUERIES = {"op12_html_extraction": op12_html_extraction}
#: Wrappers are beyond SQL; pages with known text are compared.
ORACLE = {}
