"""Sentence-level Column functions: splitting, scoring, best sentence and its
context, the extractive summary, truncation and the capital-letter splitter.

All per-document logic is written with array higher-order functions over the
sentences of one row, so it needs no shuffle: a post and its sentences never
leave the task that read them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickpulse.constants import GENERAL_KEY, SENTENCE_KEYWORDS, SUMMARY_KEYWORDS
from tickpulse.functions.text import has_digit, let, spaced_words, strip, summary_clean, word_count, words

def _empty():
    return F.array().cast("array<string>")


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def split_sentences(text) -> Column:
    """fn_split_sentences: split after . ? ! or ... followed by whitespace; trimmed, blanks
    dropped; no sentence left -> the whole text as one."""
    t = _c(text)
    parts = F.filter(F.transform(F.split(t, r"(?U)(?<=[.?!…])\s+", -1), strip), lambda s: s != "")
    return F.when(t.isNull(), _empty()).otherwise(
        let(parts, lambda ps: F.when(F.size(ps) == 0, F.array(t)).otherwise(ps)))


def _nonspace(s) -> Column:
    """``s.split()``: runs of non-whitespace (a cached constant regex, no per-row compile)."""
    return F.regexp_extract_all(s, F.lit(r"(?U)\S+"), 0)


def _base_score_of(s, low, wc) -> Column:
    score = F.when((wc >= 5) & (wc <= 25), F.lit(2.0)).when(wc > 25, F.lit(-1.0)).otherwise(F.lit(0.0))
    for kw in SENTENCE_KEYWORDS:
        score = score + F.when(F.contains(low, F.lit(kw)), F.lit(1.0)).otherwise(F.lit(0.0))
    return score + F.when(s.rlike(r"(?U)\d"), F.lit(0.5)).otherwise(F.lit(0.0))


def _base_score(s) -> Column:
    """The code-independent part of fn_sentence_score: length band, keywords, digits."""
    return let(F.struct(F.lower(s).alias("low"), F.size(_nonspace(s)).alias("wc")),
               lambda v: _base_score_of(s, v["low"], v["wc"]))


def sentence_table(sentences, codes) -> Column:
    """The sentences of a post with the codes each one names (whole words, any case).  The word runs of a sentence are
    extracted once, whatever the number of codes; what the score needs is worked out once too, for sentences that name one."""
    def entry(s):
        runs = F.regexp_extract_all(F.upper(s), F.lit(r"[\p{L}\p{N}_]+"), 0)

        def scored(hit):
            body = let(F.struct(F.lower(s).alias("low"), _nonspace(s).alias("ws")), lambda v: F.struct(
                _base_score_of(s, v["low"], F.size(v["ws"])).alias("score"), F.slice(v["ws"], 1, 3).alias("head")))
            return F.struct(s.alias("s"), hit.alias("codes"), F.when(F.size(hit) > 0, body).alias("v"))

        return let(F.array_intersect(_c(codes), runs), scored)

    return F.transform(_c(sentences), entry)


def sentence_score(sentence, code) -> Column:
    """fn_sentence_score: length band, finance keywords, digits, code near the start."""
    s = _c(sentence)
    near = F.startswith(s, _c(code)) | F.array_contains(F.slice(_nonspace(s), 1, 3), _c(code))
    return _base_score(s) + F.when(near, F.lit(1.0)).otherwise(F.lit(0.0))


def context_of(sentences, pos) -> Column:
    """win_sentence_context: previous + target + next sentence joined by a space."""
    s = _c(sentences)
    n = F.size(s)
    prev = F.when(pos > 1, F.try_element_at(s, pos - 1))
    nxt = F.when(pos < n, F.try_element_at(s, pos + 1))
    return strip(F.concat_ws(" ", prev, F.try_element_at(s, pos), nxt))


def best_sentence_index(table, code) -> Column:
    """win_best_sentence: 1-based index of the highest-scored sentence naming the code
    (whole word, any case); ties -> earliest; NULL when none names it."""
    t, c = _c(table), _c(code)

    def entry(f, i):
        near = F.startswith(f["s"], c) | F.array_contains(f["v"]["head"], c)
        score = f["v"]["score"] + F.when(near, F.lit(1.0)).otherwise(F.lit(0.0))
        return F.when(F.array_contains(f["codes"], c), F.struct(score.alias("sc"), (-i).alias("neg_i")))

    return 1 - F.array_max(F.transform(t, entry))["neg_i"]


def important_sentence(table, code) -> Column:
    """fn_important_sentence for one code: context of the best-scored sentence naming it
    (a single hit is its own best); '' when no sentence names the code.  The context is
    taken around the first sentence equal to the chosen one."""
    t = _c(table)

    def with_best(b):
        def with_sents(sents):
            return let(F.array_position(sents, F.element_at(sents, b)).cast("int"),
                       lambda p: context_of(sents, p))

        return F.when(b.isNull(), F.lit("")).otherwise(let(F.transform(t, lambda f: f["s"]), with_sents))

    return let(best_sentence_index(t, code), with_best)


def important_sentences(sentences, codes) -> Column:
    """fn_important_sentence for all codes of a post: array<struct<symbol, sentence>>.  The
    codes are worked out once per post (not once per sentence), the sentence table too."""
    return let(_c(codes), lambda cs: let(sentence_table(sentences, cs), lambda t: F.transform(
        cs, lambda c: F.struct(c.alias("symbol"), important_sentence(t, c).alias("sentence")))))


def extract_important_sentences(text, codes) -> Column:
    """fn_important_sentence: the important sentence of every code; a text that names no code gives one entry, GENERAL with
    the whole text; a NULL or empty text gives none."""
    t = _c(text)
    nothing = F.array().cast("array<struct<symbol: string, sentence: string>>")
    general = F.array(F.struct(F.lit(GENERAL_KEY).alias("symbol"), t.alias("sentence")))
    return let(_c(codes), lambda cs: F.when(t.isNull() | (t == ""), nothing)
               .when(F.coalesce(F.size(cs), F.lit(0)) <= 0, general)
               .otherwise(important_sentences(split_sentences(t), cs)))


def best_sentence_positions(sentences, codes) -> Column:
    """win_best_sentence for all codes of a post: array<struct<symbol, best_pos>>; codes and table as above."""
    return let(_c(codes), lambda cs: let(sentence_table(sentences, cs), lambda t: F.transform(
        cs, lambda c: F.struct(c.alias("symbol"), best_sentence_index(t, c).alias("best_pos")))))


# ---------------------------------------------------------------------------
# extractive summary
# ---------------------------------------------------------------------------

def truncate_text(text, n: int) -> Column:
    """fn_truncate: cut to n; end at punctuation within the last 20 chars, else at the last
    space + '...', else + '...'."""
    t = _c(text)
    cut = F.substring(t, 1, n)
    rev = F.reverse(cut)
    lc = F.length(cut)

    def last_pos(ch):  # 0-based index of the last ch in cut, -1 if none
        p = F.locate(ch, rev)
        return F.when(p == 0, F.lit(-1)).otherwise(lc - p)

    last_punct = F.greatest(last_pos("."), last_pos("!"), last_pos("?"))
    last_space = last_pos(" ")
    return (F.when(F.length(t) <= n, t)
            .when((last_punct > 0) & (last_punct > lc - 20), F.substring(cut, 1, last_punct + 1))
            .when(last_space > 0, F.concat(F.substring(cut, 1, last_space), F.lit("...")))
            .otherwise(F.concat(cut, F.lit("..."))))


def _summary_sentences(cleaned, spaced: bool = False) -> Column:
    gap = " (?<=[.!?] )" if spaced else r"(?U)(?<=[.!?])\s+"  # in spaced text the one space is looked for first
    parts = F.filter(F.transform(F.split(cleaned, gap, -1), strip), lambda s: F.length(s) > 0)
    return parts


def smart_summary(text, max_length: int = 100, cleaned: bool = False, spaced: bool = False) -> Column:
    """fn_smart_summary: score candidate sentences, then greedily add the best ones.

    ``cleaned`` says that the text is clean already, ``spaced`` that ``summary_clean`` made it so: its words stand apart by
    one space each and are counted by these, not by a regex."""
    ct0 = _c(text) if cleaned else summary_clean(text)
    count = spaced_words if spaced or not cleaned else (lambda s: F.size(_nonspace(s)))

    def with_text(ct):
        def with_sents(sents):
            n = F.size(sents)

            def scored(s, i0):
                i = i0 + 1

                def body(v):
                    wc, low = v["wc"], v["low"]
                    kw = F.lit(False)
                    for k in SUMMARY_KEYWORDS:
                        kw = kw | F.contains(low, F.lit(k))
                    sc = (F.when(i == 1, 3).when(i <= 3, 1).otherwise(0)
                          + F.when(kw, 2).otherwise(0)
                          + F.when(has_digit(s), 1).otherwise(0)
                          + F.when((wc >= 8) & (wc <= 25), 1).otherwise(0))
                    return F.struct((-sc).alias("neg"), i.alias("i"), s.alias("s"), wc.alias("wc"))

                return let(F.struct(count(s).alias("wc"), F.lower(s).alias("low")), body)

            def with_cands(cands):
                # score desc, then position: a stable sort; a sentence is added or ends the summary, so the first three settle it
                ordered = F.slice(F.sort_array(cands), 1, 3)
                init = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("total"),
                                F.lit(False).alias("done"))

                def step(acc, r):
                    s = r["s"]
                    fits = (acc["total"] + F.length(s)) <= max_length
                    add = ~acc["done"] & fits
                    parts = F.when(add, F.array_append(acc["parts"], s)).otherwise(acc["parts"])
                    done = acc["done"] | ~fits | (F.size(parts) >= 3)
                    total = F.when(add, acc["total"] + F.length(s) + 1).otherwise(acc["total"])
                    return F.struct(parts.alias("parts"), total.alias("total"), done.alias("done"))

                picked = F.aggregate(ordered, init, step)["parts"]
                fallback_first = F.filter(sents, lambda s: (count(s) >= 10) & (count(s) <= 40))
                no_cands = F.when(F.size(fallback_first) > 0,
                                  truncate_text(F.element_at(fallback_first, 1), max_length)) \
                    .otherwise(truncate_text(ct, max_length))
                return (F.when(F.size(cands) == 0, no_cands)
                        .otherwise(let(picked, lambda ps: F.when(F.size(ps) == 0, truncate_text(F.element_at(sents, 1), max_length))
                                       .otherwise(let(F.array_join(ps, " "), lambda joined: truncate_text(joined, max_length))))))

            cands = F.filter(F.transform(sents, scored), lambda r: (r["wc"] >= 5) & (r["wc"] <= 50))
            return (F.when(n == 0, F.concat(F.substring(ct, 1, max_length), F.lit("...")))
                    .otherwise(let(cands, with_cands)))

        return F.when(count(ct) <= 8, ct).otherwise(let(_summary_sentences(ct, spaced or not cleaned), with_sents))

    return let(ct0, with_text)


def summary_post_process(summary, original, max_length: int = 100) -> Column:
    """fn_summary_post: drop label words; too short -> smart summary of the original; end with . ! ?"""
    s = F.regexp_replace(_c(summary), r"(?iU)\b(vietnews|tóm tắt|summary):?\s*", "")
    ended = F.when(s.rlike(r"[.!?]$"), s).otherwise(F.concat(F.regexp_replace(s, r"(?U)\s+$", ""), F.lit(".")))
    return F.when(word_count(s) < 5, smart_summary(original, max_length)).otherwise(ended)


# ---------------------------------------------------------------------------
# capital-letter sentence split (YouTube mentions)
# ---------------------------------------------------------------------------

def split_by_capital(text) -> Column:
    """fn_split_by_capital: a word starting upper-case opens a new sentence, unless the word is
    all [A-Z0-9] and longer than one character.  Sentences are the word runs joined by one space.

    Linear in the text: the words are joined by single spaces and split with one regex
    at every space followed by such an opening word.
    """
    joined = F.array_join(words(_c(text)), " ")
    parts = F.split(joined, r" (?=\p{Lu})(?![A-Z0-9]{2,}(?: |$))", -1)
    return F.filter(parts, lambda s: s != "")

