"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, schemes, and cues of
accounts and secrets. A deterministic local parser expands each anchor to the left
and right and validates what it finds. Number kinds have no fixed anchor; their
parsers start at digits and plus signs. All parsers run in time linear in the text.

Base kinds (fixed values of the contract; leftmost, without overlap, a failing
match is dropped): ``email``, ``ip`` (parts up to 255), ``card`` (16 to 19 digits,
Luhn), ``phone`` (8 to 15 digits). The method adds ``account`` (cue and a value with
digits, such as account numbers, passwords and tokens), ``iban`` (checksum) and
``url`` (links that carry a user or a password). Added spans never remove base ones.

Places are code points, the end is exclusive.

Defined results: null is an empty text (no spans); repeated rows are scanned row by
row; an empty table gives an empty result; ``mask`` keeps all columns as they are
but the text (null stays null) and, where there is one, ``n_chars``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "account", "iban", "url")

#: Patterns of the base kinds, with possessive repeats where no other split can match.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Cues of identifiers; a number follows after an optional word and mark.
NUMBER_CUES = ("account", "acct", "passport", "ssn", "social security", "customer id", "konto", "cuenta", "compte")
#: Cues of secrets; a value follows after ``=`` or ``:``.
SECRET_CUES = ("password", "passwd", "token", "api_key", "api key", "apikey", "secret", "username", "login")
SCHEMES = ("http://", "https://", "ftp://", "ssh://")
_NUMBER = re.compile(r"[\x20\t]{0,3}(?:no\.?|nr\.?|number|id|#)?[\x20\t]{0,3}[:=#]?[\x20\t]{0,3}([A-Za-z]{0,3}[0-9](?:[\x20-]?[0-9]){5,}+)(?![0-9A-Za-z])", re.I)
_SECRET = re.compile(r"[\x20\t]{0,3}[:=][\x20\t]{0,3}[\"']?([A-Za-z0-9_+/.~!@$%^&*-]{6,}+)")
_IBAN = re.compile(r"[A-Za-z]{2}[0-9]{2}(?:\x20?[A-Za-z0-9]){11,30}+")
_USERINFO = re.compile(r"[^\s/@:?#]++(?::[^\s/@?#]*+)?@[A-Za-z0-9.-]++(?::[0-9]++)?(?:/[^\s\"'<>]*+)?")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    found.add_word("@", ("email", 1))
    for kind, cues in (("url", SCHEMES), ("number", NUMBER_CUES), ("secret", SECRET_CUES), ("iban", ("iban",))):
        for cue in cues:
            found.add_word(cue, (kind, len(cue)))
    found.make_automaton()
    return found


ANCHORS = _automaton()
_FOLD = {c: c + 32 for c in range(65, 91)}


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def iban_ok(value: str) -> bool:
    value = value.replace(" ", "").upper()
    return 15 <= len(value) <= 34 and int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def _numbers(text: str) -> Iterator[tuple[str, int, int]]:
    for m in _IP.finditer(text):
        parts = m.group().split(".")
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts):
            yield "ip", *m.span()
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield "card", *m.span()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(map(str.isdigit, m.group())) <= 15:
                yield "phone", *m.span()


def _iban_end(text: str, at: int) -> int | None:
    m = _IBAN.match(text, at)
    end = m.end() if m else at
    while m and end - at >= 15:
        if text[end - 1] != " " and (end == len(text) or not text[end].isalnum()) and iban_ok(text[at:end]):
            return end
        end -= 1
    return None


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """All spans as (kind, start, end), by kind in the order of ``KINDS``, then by start."""
    folded = text.lower()
    if len(folded) != len(text):
        folded = text.translate(_FOLD)
    found, past = [], dict.fromkeys(KINDS, 0)

    def add(kind: str, start: int, end: int) -> None:
        if start >= past[kind]:
            found.append((kind, start, end))
            past[kind] = end

    for last, (anchor, size) in ANCHORS.iter(folded):
        after = last + 1
        if anchor == "email":
            start = last
            while start > past["email"] and text[start - 1] in _LOCAL_CHARS:
                start -= 1
            m = _DOMAIN.match(text, after) if start < last else None
            if m:
                add("email", start, m.end())
        elif anchor == "url":
            # An anchor within the last span would run to the same end again.
            m = _USERINFO.match(text, after) if after - size >= past["url"] else None
            if m:
                add("url", after - size, m.end())
        elif anchor == "iban":
            at = after
            while at < len(text) and at < after + 3 and text[at] in " :":
                at += 1
            end = _iban_end(text, at)
            if end:
                add("iban", at, end)
        elif after == size or not text[after - size - 1].isalnum():  # cues begin a word
            m = (_NUMBER if anchor == "number" else _SECRET).match(text, after)
            if m and (anchor == "number" or any(c.isdigit() for c in m.group(1))):
                add("account", *m.span(1))
    found += _numbers(text)
    return sorted(found, key=lambda s: (KINDS.index(s[0]), s[1]))


def mask_text(text: str) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans are one, named by the first."""
    out, at = [], 0
    merged: list[list] = []
    for kind, start, end in sorted(find_spans(text), key=lambda s: (s[1], KINDS.index(s[0]))):
        if merged and start < merged[-1][2]:
            merged[-1][2] = max(end, merged[-1][2])
        else:
            merged.append([kind, start, end])
    for kind, start, end in merged:
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]]) if merged else text


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column("text"):
            spans = find_spans(text.as_py() or "")
            base = [s for s in spans if s[0] in BASE]
            rows.append((*[sum(s[0] == k for s in base) for k in BASE], hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 6
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns[:4]], *[pa.array(c, pa.string()) for c in columns[4:]]],
            names=["doc_id", *[f"n_{k}" for k in BASE], "base_sha256", "spans"])


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of the base kinds, their digest and all spans of every document."""
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = plain.schema["doc_id"].dataType.simpleString()
    return plain.mapInArrow(_scan, f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string")


def mask(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with personal data masked in their text."""
    names = docs.columns
    at = names.index(text)
    length = names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            before = columns[at].to_pylist()
            after = [None if t is None else mask_text(t) for t in before]
            columns[at] = pa.array(after, columns[at].type)
            if length is not None:
                kept = columns[length].to_pylist()
                columns[length] = pa.array([n if a == b or n is None else len(b) for n, a, b in zip(kept, before, after, strict=True)], columns[length].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def op5_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data in every text of ``documents``."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op5_pii": op5_pii}
#: Places of matches are beyond SQL; the scan is tested against plain patterns.
ORACLE = {}
