"""Ticker recognition Column functions (fn_ticker_rules and friends).

The ticker dictionary is a dimension table.  ``TickerDictionary`` reads it
once per job (stock exchanges list some thousand symbols) and makes it an ``IN``
set that Catalyst turns into a hash lookup evaluated inside the scan stage, so no
shuffle or join is needed for membership.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickpulse.constants import COMMON_WORDS, CONTEXT_RADIUS, CONTEXT_VETO_WORDS, VIETNAMESE_ACCENTS
from tickpulse.functions.text import strip, stripped_length

# whole-word 2-4 letter upper-case runs (Unicode word boundaries)
CANDIDATE = r"(?<![\p{L}\p{N}_])[A-Z]{2,4}(?![\p{L}\p{N}_])"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _ww(word: str) -> str:
    """Java regex for ``\\bword\\b`` with Python's Unicode word characters."""
    return r"(?<![\p{L}\p{N}_])" + re.escape(word).replace("\\&", "&") + r"(?![\p{L}\p{N}_])"


def candidates(text) -> Column:
    """2-4 letter whole-word codes of the upper-cased text, first-seen order, distinct."""
    return F.array_distinct(F.regexp_extract_all(F.upper(_c(text)), F.lit(CANDIDATE), 0))


def upper_in_text(text, code: str) -> Column:
    """fn_upper_in_text: some whole-word occurrence of ``code`` is upper case in the original."""
    return _c(text).rlike(_ww(code))


def raw_runs(text) -> Column:
    """The 2-4 letter whole-word codes that stand in the text in upper case: what ``upper_in_text`` finds, for any number of codes."""
    return F.array_distinct(F.regexp_extract_all(_c(text), F.lit(CANDIDATE), 0))


def context_ok(text, code: str | Column, radius: int = CONTEXT_RADIUS) -> Column:
    """fn_ticker_context_ok: no veto word next to the code in any +-radius character window.  ``code`` may be a column of 2-4 letter codes.

    Occurrences are the non-overlapping case-insensitive matches of ``code``.
    One regex pass per part captures, for every occurrence, the ``radius``
    characters before it (fewer at the start of the text), the occurrence and
    the ``radius`` characters after it, so the cost is linear in the text.
    Each window is lower-cased and split on whitespace; a word containing the
    code is vetoed when its left or right neighbour is a veto word.
    """
    t = _c(text)
    # the code is matched first; only then is the bounded look-behind checked
    behind, ahead = f"(?<=(.{{{radius}}}|^.{{0,{radius - 1}}})", f")(?=(.{{0,{radius}}}))"
    if isinstance(code, str):
        body = re.escape(code).replace("\\&", "&")
        low, pat = F.lit(code.lower()), F.lit(f"(?si){body}{behind}{body}{ahead}")
    else:
        low, pat = F.lower(code), F.concat(F.lit("(?si)"), code, F.lit(behind), code, F.lit(ahead))
    pre = F.regexp_extract_all(t, pat, 1)
    mid = F.regexp_extract_all(t, pat, 0)
    post = F.regexp_extract_all(t, pat, 2)
    veto = list(CONTEXT_VETO_WORDS)

    def window_bad(z):
        ws = F.filter(F.split(F.lower(F.concat(z["pre"], z["mid"], z["post"])), r"(?U)\s+"), lambda w: w != "")
        size = F.size(ws)

        def bad_at(i):
            prev = F.when(i > 1, F.try_element_at(ws, i - 1)).otherwise(F.lit(""))
            nxt = F.when(i < size, F.try_element_at(ws, i + 1)).otherwise(F.lit(""))
            return F.contains(F.try_element_at(ws, i), low) & (prev.isin(*veto) | nxt.isin(*veto))

        return (size > 1) & F.exists(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), bad_at)

    zipped = F.arrays_zip(pre.alias("pre"), mid.alias("mid"), post.alias("post"))
    # a window is vetoed by a veto word only, so a text that holds none needs no windows
    veto_somewhere = _let(F.lower(t), lambda x: reduce(or_, [F.contains(x, F.lit(w)) for w in veto]))
    return F.when(veto_somewhere, ~F.coalesce(F.exists(zipped, window_bad), F.lit(False))).otherwise(F.lit(True))


@dataclass
class TickerDictionary:
    """A ticker set, inlined into expressions as a hash set.  It is as large as the exchanges' listings;
    ``operators.joins.dictionary_hits`` joins a dictionary that stays a table."""

    symbols: list[str]

    @classmethod
    def from_table(cls, df: DataFrame, col: str = "symbol"):
        dim = df.select(F.upper(strip(F.col(col))).alias("s")).where("s <> ''").distinct()
        return cls(sorted(r.s for r in dim.collect()))

    @property
    def common(self) -> list[str]:
        common = set(COMMON_WORDS)
        return [s for s in self.symbols if s in common]

    @property
    def plain(self) -> list[str]:
        common = set(COMMON_WORDS)
        return [s for s in self.symbols if s not in common]

    def member(self, x: Column) -> Column:
        return x.isin(*self.symbols) if self.symbols else F.lit(False)


def _let(value, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` as a lambda variable, so the
    optimizer cannot copy the (text-sized) expression into per-element lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _common_flags(t, cands, common: list[str]) -> Column:
    """struct of per-row flags: common-word code ``c`` is upper case somewhere and has no veto."""
    if not common:
        return F.struct(F.lit(True).alias("none"))
    return F.struct(*[
        F.when(F.array_contains(cands, F.lit(c)), upper_in_text(t, c) & context_ok(t, c)).otherwise(F.lit(False))
        .alias(f"f{i}") for i, c in enumerate(common)])


def rule_codes(text, dictionary: TickerDictionary) -> Column:
    """fn_ticker_rules: dictionary tickers named in ``text`` (sorted, distinct).

    Text shorter than 5 stripped characters has none.  A code that is also a
    common word counts only if it appears upper case as a whole word and no
    veto word stands next to it.  The candidates and the per-row flags are
    computed once per row.
    """
    t = _c(text)
    plain = dictionary.plain
    common = dictionary.common

    def with_cands(cs):
        def with_flags(fl):
            def keep(x):
                cond = x.isin(*plain) if plain else F.lit(False)
                for i, c in enumerate(common):
                    cond = cond | ((x == F.lit(c)) & fl[f"f{i}"])
                return cond

            return F.array_sort(F.filter(cs, keep))

        return _let(_common_flags(t, cs, common), with_flags)

    return F.when(stripped_length(t) >= 5, _let(candidates(t), with_cands)).otherwise(F.array().cast("array<string>"))


def candidate_gate(text, cand_col, dictionary: TickerDictionary) -> Column:
    """fn_candidate_gate: filter model-proposed entity strings to valid tickers."""
    t = _c(text)
    accents = "[" + VIETNAMESE_ACCENTS + "]"
    common = dictionary.common
    cands = F.transform(F.coalesce(_c(cand_col), F.array().cast("array<string>")), lambda e: F.upper(strip(e)))

    def with_cands(cs):
        def with_flags(fl):
            def keep(u):
                base = (~F.lower(u).rlike(accents)) & (F.length(u) > 2) & (F.length(u) <= 4) \
                    & u.rlike(r"^\p{L}+$") & dictionary.member(u)
                common_ok = F.lit(False)
                for i, c in enumerate(common):
                    common_ok = common_ok | ((u == F.lit(c)) & fl[f"f{i}"])
                plain_ok = F.array_contains(fl["up_runs"], u)
                return base & F.when(u.isin(*common) if common else F.lit(False), common_ok).otherwise(plain_ok)

            return F.array_sort(F.array_distinct(F.filter(cs, keep)))

        flags = _common_flags(t, cs, common)
        flags = flags.withField("up_runs", F.array_distinct(F.regexp_extract_all(F.upper(t), F.lit(r"[\p{L}\p{N}_]+"), 0)))
        return _let(flags, with_flags)

    return F.when(F.length(t) >= 10, _let(cands, with_cands)).otherwise(F.array().cast("array<string>"))


def extract_codes(text, dictionary: TickerDictionary, model_candidates=None) -> Column:
    """fn_extract_codes: rule hits united with gated model candidates, dictionary-filtered."""
    rules = rule_codes(text, dictionary)
    if model_candidates is None:
        codes = rules
    else:
        codes = F.array_sort(F.array_distinct(F.array_union(rules, candidate_gate(text, model_candidates, dictionary))))
    return F.when(stripped_length(text) >= 5, codes).otherwise(F.array().cast("array<string>"))


def has_mention(codes) -> Column:
    return F.size(_c(codes)) > 0


def symbols_csv(text, dictionary: TickerDictionary) -> Column:
    """fn_symbols_csv: sorted distinct whole-word dictionary hits of upper(text), ','-joined; none -> NULL.

    Word-character tickers are matched on whole-word runs of the upper-cased
    text; tickers with other characters (such as 'M&A') by their own regex.
    """
    up = F.upper(_c(text))
    wordlike = [s for s in dictionary.symbols if re.fullmatch(r"[\w]+", s)]
    other = [s for s in dictionary.symbols if s not in set(wordlike)]
    runs = F.array_distinct(F.regexp_extract_all(up, F.lit(r"[\p{L}\p{N}_]+"), 0))
    hits = F.filter(runs, lambda w: w.isin(*wordlike)) if wordlike else F.array().cast("array<string>")
    for s in other:
        hits = F.when(up.rlike(_ww(s)), F.array_union(hits, F.array(F.lit(s)))).otherwise(hits)
    joined = F.array_join(F.array_sort(F.array_distinct(hits)), ",")
    return F.when(_c(text).isNull() | (_c(text) == ""), F.lit(None)).otherwise(F.nullif(joined, F.lit("")))

