"""String and regex Column functions (inventory 2.9).

Every function takes and returns a Column, so they run JVM-side inside
whole-stage code generation.  Java regexes are made Unicode-aware with
``(?U)`` to follow the Unicode semantics of ``\\w``, ``\\s`` and ``\\b`` in
the reproduced rules.  The one Python function is ``nfc`` (Spark has no
Unicode normaliser); it is an Arrow-batched ``pandas_udf`` that skips ASCII.
"""

from __future__ import annotations

import html
import unicodedata
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickpulse.constants import (FALLBACK_STOPWORDS, SUMMARY_LABEL_PATTERN, VIETNAMESE_ACCENTS,
                                 VIETNAMESE_ACCENTS_UPPER)

# Python's \w: letters, digits and the underscore (combining marks excluded)
WORD_CHAR = r"[\p{L}\p{N}_]"
NOT_WORD_CHAR = r"[^\p{L}\p{N}_]"
URL_ANY = r"(?U)http\S+|www\S+"
URL_HTTP = r"(?U)http\S+"
TOKEN = r"[a-zA-ZÀ-ỹ0-9]+"
TOKEN_WITH_LETTER = r"(?<![a-zA-ZÀ-ỹ0-9])[a-zA-ZÀ-ỹ0-9]*[a-zA-ZÀ-ỹ][a-zA-ZÀ-ỹ0-9]*"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# FIXED VALUES: the characters Python's str.strip() removes (str.isspace)
PY_WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
                 "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def let(value, body) -> Column:
    """Evaluate ``value`` once per row and pass it to ``body`` as a lambda variable (so the
    optimizer cannot re-inline it inside per-element lambdas)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(col) -> Column:
    """Python ``str.strip()``: remove whitespace at both ends (scans only the ends, no regex)."""
    return F.btrim(_c(col), F.lit(PY_WHITESPACE))


def stripped_length(col) -> Column:
    return F.length(strip(col))


def collapse_spaces(col) -> Column:
    return strip(F.regexp_replace(_c(col), r"(?U)\s+", " "))


def text_present(col) -> Column:
    """flt_text_present: not NULL, not '' and not the 'NA' marker."""
    c = _c(col)
    return c.isNotNull() & (c != "") & (c != "NA")


@F.pandas_udf(T.StringType())
def _nfc_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda v: v if v is None else unicodedata.normalize("NFC", v))


_NFC_TRIGGERS: str | None = None


def _nfc_trigger_class() -> str:
    """Java regex class of the characters that can change under NFC: marks (reordering and
    composition), characters whose own NFC differs (singletons, exclusions), non-mark second
    characters of canonical pairs, and conjoining Hangul vowels / trailing consonants.
    A text with none of them is already NFC, so it never leaves the JVM."""
    global _NFC_TRIGGERS
    if _NFC_TRIGGERS is None:
        extra = set(range(0x1161, 0x1176)) | set(range(0x11A8, 0x11C3))
        for cp in range(0x110000):
            if 0xD800 <= cp <= 0xDFFF:
                continue
            ch = chr(cp)
            if unicodedata.category(ch).startswith("M"):
                continue
            if unicodedata.normalize("NFC", ch) != ch:
                extra.add(cp)
            dec = unicodedata.decomposition(ch)
            if dec and not dec.startswith("<"):
                parts = dec.split()
                if len(parts) == 2:
                    second = int(parts[1], 16)
                    if not unicodedata.category(chr(second)).startswith("M"):
                        extra.add(second)
        ranges, run = [], []
        for cp in sorted(extra):
            if run and cp == run[-1] + 1:
                run.append(cp)
            else:
                if run:
                    ranges.append((run[0], run[-1]))
                run = [cp]
        if run:
            ranges.append((run[0], run[-1]))
        body = "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges)
        _NFC_TRIGGERS = "[\\p{M}" + body + "]"
    return _NFC_TRIGGERS


def nfc(col) -> Column:
    """fn_nfc: Unicode NFC.  Only rows holding a character that NFC can change go through
    the Arrow-batched Python normaliser; all others stay in the JVM unchanged."""
    c = _c(col)
    # every character below U+0300 is NFC-stable: one range test per character first, the
    # full trigger class only for texts that hold a character at or above U+0300
    needs = c.rlike("[^\\x{0}-\\x{2FF}]") & c.rlike(_nfc_trigger_class())
    # Spark evaluates a Python UDF for every row of the batch, so rows that cannot change
    # are sent as NULL: only the texts that need it cross into Python.
    return F.when(needs, _nfc_udf(F.when(needs, c))).otherwise(c)


def raw_tokens(col) -> Column:
    """lower -> drop links -> maximal word runs that hold at least one non-digit (all-digit runs
    are never extracted).  NULL text gives NULL."""
    low = F.regexp_replace(F.lower(_c(col)), URL_ANY, "")
    return F.regexp_extract_all(low, F.lit(TOKEN_WITH_LETTER), 0)


def keep_token(t: Column, stopwords: list[str] | None = None) -> Column:
    """The tokenizer's per-token rule: longer than one character and not a stopword."""
    stop = FALLBACK_STOPWORDS if stopwords is None else stopwords
    return (F.length(t) > 1) & ~t.isin(*stop) if stop else (F.length(t) > 1)


def tokenize(col, stopwords: list[str] | None = None) -> Column:
    """fn_tokenize: lower -> drop links -> word runs -> drop stopwords, 1-char and all-digit tokens.

    NULL text gives an empty array.
    """
    kept = F.filter(raw_tokens(col), lambda t: keep_token(t, stopwords))
    return F.coalesce(kept, F.array().cast("array<string>"))


def clean_token(t: Column) -> Column:
    """fn_ensure_token_list's per-token trim.  Regex tokens can hold only one whitespace
    character (U+1680, inside the letter range), so only those are stripped."""
    return F.when(F.contains(t, F.lit("\u1680")), strip(t)).otherwise(t)


def ensure_token_list(col) -> Column:
    """fn_ensure_token_list: trim each token, drop NULL and blank ones."""
    return F.filter(F.transform(F.coalesce(_c(col), F.array().cast("array<string>")), clean_token),
                    lambda t: t.isNotNull() & (t != ""))


# kept characters: word characters, whitespace and . , ! ? ; : -  (the accented Vietnamese
# letters the rule lists explicitly are all letters, i.e. already inside \p{L})
# What is no kept character is a space, and runs of spaces are one: one pass over runs of everything
# but the kept characters that are not whitespace does both.
_DROPPED = r"[^\p{L}\p{N}_.,!?;:\-]+"


def _replaced(t, pattern: str, to: str, marks: list[str]) -> Column:
    """``regexp_replace`` for a pattern that needs one of ``marks``: a text that holds none is not scanned by the regex."""
    return let(t, lambda x: F.when(reduce(or_, [F.contains(x, F.lit(m)) for m in marks]), F.regexp_replace(x, pattern, to)).otherwise(x))


def _clean_marks(t, url: str, url_marks: list[str]) -> Column:
    """Links, mentions and hashtags go, then symbols and spaces."""
    t = _replaced(t, url, "", url_marks)
    t = _replaced(t, r"@[\p{L}\p{N}_]+", "", ["@"])
    t = _replaced(t, r"#([\p{L}\p{N}_]+)", "$1", ["#"])
    return strip(F.regexp_replace(t, _DROPPED, " "))


def sentiment_clean(col) -> Column:
    """fn_sentiment_clean (after NFC): links, mentions, hashtags, symbols, spaces."""
    return _clean_marks(_c(col), URL_ANY, ["http", "www"])


@F.pandas_udf(T.StringType())
def _unescape_udf(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def html_unescape(col) -> Column:
    """All named, decimal and hexadecimal entities, once; only texts that can hold one leave the JVM."""
    t = _c(col)
    may = t.rlike("&[#A-Za-z]")
    return F.when(may, _unescape_udf(F.when(may, t))).otherwise(t)


def summary_clean(col) -> Column:
    """fn_summary_clean: entities, http links (not www), mentions, hashtags, symbols, spaces."""
    return F.coalesce(_clean_marks(html_unescape(_c(col)), URL_HTTP, ["http"]), F.lit(""))


def spaced_words(col) -> Column:
    """``word_count`` of a text whose words stand apart by one space each, as the cleaners leave them."""
    c = _c(col)
    return F.when(c == "", 0).otherwise(F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit(""))) + 1)


def validate_symbol(col) -> Column:
    """prj_validate_symbol: strip, upper, drop [^A-Z0-9], empty -> NULL (cleaned whole, never cut)."""
    return F.nullif(F.regexp_replace(F.upper(strip(_c(col))), "[^A-Z0-9]", ""), F.lit(""))


def word_count(col) -> Column:
    """``len(text.split())``: runs of non-whitespace."""
    return F.size(F.filter(F.split(strip(_c(col)), r"(?U)\s+"), lambda w: w != ""))


def words(col) -> Column:
    """``text.split()`` as an array."""
    return F.filter(F.split(_c(col), r"(?U)\s+"), lambda w: w != "")


def has_digit(col) -> Column:
    return _c(col).rlike(r"(?U)\d")


def first_paragraph(col) -> Column:
    """fn_first_paragraph: the text before the first blank-line break."""
    return F.element_at(F.split(_c(col), r"\n\n+"), 1)
