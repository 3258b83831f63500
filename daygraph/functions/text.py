"""Text expressions: time references, banned phrases, markdown, dates, JSON."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from daygraph import constants as C

WORD = r"\p{L}\p{N}_"


def _found(kind: str, phrase: str) -> Column:
    return F.lit(f"extra {kind} reference '{phrase}' not in graph")


def snippet(text: Column, start: Column, length: int) -> Column:
    """25 characters of context on both sides; ``start`` is one-based."""
    begin = F.greatest(start - 25, F.lit(1))
    stop = start + length + 25
    return F.trim(F.replace(F.substring(text, begin, stop - begin), F.lit("\n"), F.lit(" ")))


def _hit(cond: Column, kind: str, phrase: str, text: Column, at: Column) -> Column:
    return F.when(cond, F.struct(F.lit(kind).alias("kind"), _found(kind, phrase).alias("content"), snippet(text, at, len(phrase)).alias("evidence")))


def time_words(text: Column, low: Column, language: Column) -> Column:
    """Time words of a text with their context and kind (future, past, time), whatever its graph licenses.

    ``low`` is the lower-case text as a column of its own, so it is made once per row.
    """
    at = lambda phrase: F.instr(low, phrase)
    has = lambda phrase: F.contains(low, F.lit(phrase))

    english = [_hit(has("tomorrow") & ~has("the day after tomorrow"), "future", "tomorrow", text, at("tomorrow"))]
    english += [_hit(has(p), "past", p, text, at(p)) for p in C.PAST_EN]
    english += [_hit(has(p), "time", p, text, at(p)) for p in C.EXTRA_TIME_EN]

    adverb = rf"(?<![{WORD}])(?<![Hh][Ee][Uu][Tt][Ee] )morgen(?![{WORD}])"
    place = F.regexp_instr(text, F.lit(adverb))
    german = [_hit(has("morgen") & (place > 0), "future", "morgen", text, place)]
    german += [_hit(has(p), "past", p, text, at(p)) for p in C.PAST_DE]
    german += [_hit(has(p), "time", p, text, at(p)) for p in C.EXTRA_TIME_DE]
    return F.array_compact(F.when(language == "de", F.array(*german)).otherwise(F.array(*english)))


def unlicensed(words: Column, offsets: Column) -> Column:
    """Those of ``time_words`` that no node's day offset licenses: future words need a 1, past words a -1."""
    no_future = ~F.array_contains(offsets, 1)
    no_past = ~F.array_contains(offsets, -1)
    left = F.filter(words, lambda w: F.when(w["kind"] == "future", no_future).when(w["kind"] == "past", no_past).otherwise(True))
    return F.transform(left, lambda w: F.struct(w["content"].alias("content"), w["evidence"].alias("evidence")))


def time_extras(text: Column, low: Column, language: Column, offsets: Column) -> Column:
    """Time words that no node's day offset licenses, with their context."""
    return unlicensed(time_words(text, low, language), offsets)


def german_tomorrow(text: Column) -> Column:
    return F.contains(text, F.lit("morgen")) & text.rlike(rf"(?<![{WORD}])morgen(?![{WORD}])")


def phrase_hit(low: Column, phrase: str, pattern: str) -> Column:
    """The phrase where the pattern matches; a plain substring test rules out most texts first."""
    return F.when(F.contains(low, F.lit(phrase)) & low.rlike(pattern), phrase)


def banned_en(low: Column) -> Column:
    return F.array_compact(F.array(*[phrase_hit(low, p, rf"(?<![a-z]){re.escape(p)}(?![a-z])") for p in C.BANNED_EN]))


def banned_de(low: Column) -> Column:
    """Whole phrases and words, then stems that may carry an ending."""
    letter = C.GERMAN_LETTERS
    whole = [phrase_hit(low, p, rf"(?<![{letter}]){p}(?![{letter}])") for p in C.BANNED_DE]
    stems = [phrase_hit(low, s, rf"(?<![{letter}]){s}") for s in C.BANNED_STEMS_DE]
    return F.array_compact(F.array(*whole, *stems))


def banned(low: Column, language: Column) -> Column:
    return F.when(language == "de", banned_de(low)).otherwise(banned_en(low))


def word_count(text: Column) -> Column:
    """Whitespace-separated words."""
    trimmed = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, " "))).cast("long")


# Fixed patterns: markdown noise, applied in this order (pattern, replacement).
MARKDOWN_STEPS = [
    (r"```[\s\S]*?(```|\z)", " "),                      # fenced code
    (r"`([^`\n]*)`", "$1"),                              # inline code
    (r"!\[\[[^\]]*\]\]", " "),                           # embeds
    (r"!\[[^\]]*\]\([^)]*\)", " "),                      # images
    (r"\[\[([^\]|]*)\|([^\]]*)\]\]", "$2"),              # wikilinks with an alias
    (r"\[\[([^\]]*)\]\]", "$1"),                         # wikilinks
    (r"\[([^\]]*)\]\([^)]*\)", "$1"),                    # links
    (r"(?m)^#{1,6}\s+", ""),                             # headings
    (r"(?m)^(\s*)[-*+]\s+\[[ xX]\]\s+", "$1"),           # checkboxes
    (r"(?m)^(\s*)[-*+]\s+", "$1"),                       # bullets
    (r"(?m)^\s*>\s?", ""),                               # quotes
    (r"(^|\s)#[\w/-]+", "$1"),                           # tags
    (r"(?:\*\*)(.*?)(?:\*\*)|(?:__)(.*?)(?:__)", "$1$2"),  # bold
    (r"\*(.*?)\*|_(.*?)_", "$1$2"),                      # italic
    (r"(?m)^\s*(---+|===+|\*\*\*+)\s*$", ""),            # rules
    (r"[ \t]+", " "),
    (r"\n{3,}", "\n\n"),
]


#: What a text must contain for the step at the same place of MARKDOWN_STEPS to change it.
MARKDOWN_SIGNS = [
    ["```"], ["`"], ["![["], ["!["], ["[["], ["[["], ["]("], ["#"], ["["], ["-", "*", "+"], [">"], ["#"],
    ["**", "__"], ["*", "_"], ["---", "===", "***"], ["\t", "  "], ["\n\n\n"],
]
#: White space as patterns know it.
BLANKS = " \t\n\x0b\f\r"


def clean_markdown(body: Column) -> Column:
    """Text without markup. A step's pattern is tried where the text holds one of its signs."""
    def step(signs: list[str], pattern: str, replacement: str):
        found = lambda x: reduce(or_, [F.contains(x, F.lit(s)) for s in signs])
        return lambda x: F.when(found(x), F.regexp_replace(x, pattern, replacement)).otherwise(x)

    out = F.array(body)  # an array of one: every step names its text once
    for signs, (pattern, replacement) in zip(MARKDOWN_SIGNS, MARKDOWN_STEPS, strict=True):
        out = F.transform(out, step(signs, pattern, replacement))
    return F.btrim(out[0], F.lit(BLANKS))


MOOD_KEYS = ["mood_score", "mood", "rating"]


def _front_end(raw: Column) -> Column:
    """Place of the line end before the closing rule of the front block, 0 where there is no block."""
    return F.when(raw.startswith("---\n"), F.locate("\n---", raw, 5)).otherwise(F.when(raw.isNotNull(), 0))


def has_front(raw: Column) -> Column:
    return _front_end(raw) > 0


def front_fields(raw: Column) -> Column:
    """Key to value map of the front block; a later line wins over an earlier one."""
    end = _front_end(raw)
    lines = F.filter(F.split(F.when(end > 0, F.substring(raw, F.lit(5), end - 5)), "\n"), lambda x: F.instr(x, ":") > 0)
    pairs = F.transform(lines, lambda x: F.struct(
        F.trim(F.substring_index(x, ":", 1)).alias("key"),
        F.trim(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("value"),
    ))
    named = F.filter(pairs, lambda p: p["key"] != "")
    # An array of one: the lines are made once, not again for every line.
    last = F.transform(F.array(named), lambda n: F.filter(
        n, lambda p, i: ~F.exists(F.slice(n, i + 2, F.greatest(F.size(n), F.lit(1))), lambda q: q["key"] == p["key"])))[0]
    return F.map_from_entries(last)


def front_body(raw: Column) -> Column:
    end = _front_end(raw)
    return F.when(end > 0, F.btrim(F.substring(raw, end + 4, F.length(raw)), F.lit(BLANKS))).otherwise(raw)


def mood_alias(fields: Column) -> Column:
    """First of the mood keys with a finite number; a blank value counts as zero."""
    def number(key: str) -> Column:
        value = F.try_element_at(fields, F.lit(key))
        plain = F.when(value.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"), value.try_cast("double"))
        return F.when(value == "", F.lit(0.0)).otherwise(plain)
    return F.coalesce(*[number(k) for k in MOOD_KEYS])


def parse_date(value: Column) -> Column:
    """ISO date out of free text: year first, then day first, then compact; impossible dates fall through."""
    def attempt(pattern: str, y: int, m: int, d: int) -> Column:
        part = lambda i: F.regexp_extract(value, pattern, i)
        text = F.concat(part(y), F.lit("-"), F.lpad(part(m), 2, "0"), F.lit("-"), F.lpad(part(d), 2, "0"))
        day = F.try_to_date(text, "yyyy-MM-dd")
        return F.when(value.rlike(pattern) & F.year(day).between(1900, 2100), F.date_format(day, "yyyy-MM-dd"))
    return F.coalesce(
        attempt(r"(\d{4})[-_./](\d{1,2})[-_./](\d{1,2})", 1, 2, 3),
        attempt(r"(\d{1,2})[-./](\d{1,2})[-./](\d{4})", 3, 2, 1),
        attempt(r"(?:^|\D)(\d{4})(\d{2})(\d{2})(?:\D|$)", 1, 2, 3),
    )


def outer_json(raw: Column) -> Column:
    """The object between the first and the last brace, inside a code fence if there is one."""
    trimmed = F.regexp_replace(raw, r"\A\s+|\s+\z", "")
    fenced = F.regexp_replace(F.split(trimmed, "```", 3)[1], r"\Ajson", "")
    inner = F.when(trimmed.startswith("```"), fenced).otherwise(trimmed)
    first = F.instr(inner, "{")
    last = F.length(inner) - F.instr(F.reverse(inner), "}") + 1
    return F.when((first > 0) & (F.instr(inner, "}") > 0), F.substring(inner, first, F.greatest(last - first + 1, F.lit(0))))


def accent_table() -> tuple[str, str]:
    """Accented Latin letters and their base letters, by Unicode decomposition."""
    source, target = [], []
    for code in range(0xC0, 0x250):
        base = "".join(ch for ch in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(ch))
        if len(base) == 1 and base != chr(code):
            source.append(chr(code))
            target.append(base)
    return "".join(source), "".join(target)


def strip_accents(text: Column) -> Column:
    return F.translate(text, *accent_table())


def tokens(text: Column) -> Column:
    """Lower-case words of two or more characters, accents removed."""
    return F.regexp_extract_all(strip_accents(F.lower(text)), F.lit(rf"([{WORD}]{{2,}})"), 1)
