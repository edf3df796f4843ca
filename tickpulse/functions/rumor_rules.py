"""Rumor cue detection and rule-based rewriting as Column expressions."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickpulse.constants import (REWRITE_PREFIX_HEARSAY, REWRITE_PREFIX_OPINION, REWRITE_PREFIXES,
                                 RUMOR_PATTERNS)
from tickpulse.functions.text import collapse_spaces, strip

_LB = r"(?<![\p{L}\p{N}_])"
_LA = r"(?![\p{L}\p{N}_])"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def to_java(pattern: str) -> str:
    """Python pattern -> Java pattern with Python's Unicode ``\\b`` and ``\\s``.

    The cue patterns use ``\\b`` only next to word characters, so a boundary
    is "no word character on the other side".
    """
    out = pattern
    if out.startswith(r"\b"):
        out = _LB + out[2:]
    if out.endswith(r"\b"):
        out = out[:-2] + _LA
    return "(?U)" + out


def _head(pattern: str) -> str:
    """Plain letters that every match of the pattern opens with; '' where that cannot be told."""
    body = pattern.removeprefix(r"\b")
    depth = 0
    for c in body:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            return ""
    head = re.match(r"[^\\.\[\](){}*+?^$|]*", body).group()
    return head[:-1] if body[len(head) : len(head) + 1] in ("*", "+", "?", "{") else head


def _words(pattern: str) -> list[str]:
    """Plain words that every match holds: those between blanks, as far as the pattern has neither choices nor classes."""
    return [_head(pattern), *(w for w in re.split(r"\\s\+", pattern.removeprefix(r"\b").removesuffix(r"\b"))[1:] if re.fullmatch(r"\w+", w))] if not re.search(r"[|(\[]", pattern) else [_head(pattern)]


def rumor_pattern(text, patterns: list[str] | None = None) -> Column:
    """fn_rumor_pattern: the first cue pattern (its source text) found in lower(text), else NULL.

    A pattern is tried only on texts that hold the letters it opens with, so most rows cost plain substring searches.
    """
    pats = RUMOR_PATTERNS if patterns is None else patterns

    def first(low):
        holds = lambda p: reduce(and_, [F.contains(low, F.lit(w)) for w in _words(p)])
        return F.coalesce(*[F.when(holds(p) & low.rlike(to_java(p)), F.lit(p)) for p in pats], F.lit(None).cast("string"))

    # the lower-cased text is bound once for all patterns
    found = F.element_at(F.transform(F.array(F.lower(_c(text))), first), 1)
    return F.when(_c(text).isNull() | (_c(text) == ""), F.lit(None).cast("string")).otherwise(found)


def whole_word_patterns(words: list[str]) -> list[str]:
    """Cue patterns for plain words (used with text that has no Vietnamese cue)."""
    return [r"\b" + re.escape(w) + r"\b" for w in words]


def rewrite_rules(text, key=None, prefix_other: bool = False) -> Column:
    """fn_rewrite_rules: clean, then reword hearsay / opinion cues.

    Hearsay cue ('nghe đồn', 'nghe nói') -> cue removed, hearsay prefix;
    opinion cue ('hình như', 'có vẻ như') -> cue removed, opinion prefix;
    otherwise no rewrite (NULL) -- the caller then keeps the original text.
    With ``prefix_other`` one of three prefixes is chosen by a hash of ``key``.
    """
    t = _c(text)
    low = F.lower(t)
    cleaned = collapse_spaces(F.regexp_replace(t, r"(?U)[^\w\s.,!?]", ""))
    hearsay = F.contains(low, F.lit("nghe đồn")) | F.contains(low, F.lit("nghe nói"))
    opinion = F.contains(low, F.lit("hình như")) | F.contains(low, F.lit("có vẻ như"))
    no_hearsay = F.regexp_replace(cleaned, r"(?iU)\b(nghe\s+(đồn|nói|bảo))\b\s*", "")
    no_opinion = F.regexp_replace(cleaned, r"(?iU)\b(hình như|có vẻ như)\b\s*", "")
    if prefix_other:
        k = _c(key) if key is not None else t
        prefixes = F.array(*[F.lit(p) for p in REWRITE_PREFIXES])
        other = F.concat(F.element_at(prefixes, (F.pmod(F.xxhash64(k), F.lit(3)) + 1).cast("int")), F.lit(" "), cleaned)
    else:
        other = F.lit(None).cast("string")
    return (F.when(hearsay, F.concat(F.lit(REWRITE_PREFIX_HEARSAY), no_hearsay))
            .when(opinion, F.concat(F.lit(REWRITE_PREFIX_OPINION), no_opinion))
            .otherwise(other))


def rewrite_post(rewritten, original) -> Column:
    """fn_rewrite_post: empty or unchanged -> rules; collapse spaces; capital first letter; final . ? !"""
    r = _c(rewritten)
    o = _c(original)
    c = collapse_spaces(r)
    first = F.substring(c, 1, 1)
    cap = F.when(first != F.upper(first), F.concat(F.upper(first), F.substring(c, 2, 1 << 30))).otherwise(c)
    ended = F.when(cap.rlike(r"[.?!]$"), cap).otherwise(F.concat(cap, F.lit(".")))
    return F.when(r.isNull() | (r == "") | (strip(r) == strip(o)), rewrite_rules(o)).otherwise(ended)


def rewrite_text(text) -> Column:
    """The rewriter without a generation model: short text is returned as is, else the rules."""
    t = _c(text)
    return F.when(t.isNull() | (F.length(strip(t)) < 3), t).otherwise(rewrite_rules(t))


def accept_rewrite(rewritten, original) -> Column:
    """fn_rewrite_accept: a rewrite shorter than 3 stripped characters falls back to the original."""
    r = _c(rewritten)
    return F.when(r.isNull() | (F.length(strip(r)) < 3), _c(original)).otherwise(r)
