"""DuckDB SQL expressions mirroring the text Column functions, for the oracle.

DuckDB's regex engine (RE2) has no look-around and an ASCII ``\\b``; the
expressions below use explicit ``[\\p{L}\\p{N}_]`` classes and list lambdas
instead, which state the same rules.
"""

from __future__ import annotations

from tickpulse.constants import (COMMON_WORDS, CONTEXT_VETO_WORDS, FALLBACK_STOPWORDS, SENTENCE_KEYWORDS,
                                 SUMMARY_KEYWORDS, VIETNAMESE_ACCENTS)

W = r"\p{L}\p{N}_"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lst(items) -> str:
    return "[" + ", ".join(q(x) for x in items) + "]"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def words(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> '')"


def word_count(x: str) -> str:
    return f"len({words(strip(x))})"


def tokenize(x: str, stopwords=None) -> str:
    stop = FALLBACK_STOPWORDS if stopwords is None else stopwords
    low = rf"regexp_replace(lower({x}), 'http\S+|www\S+', '', 'g')"
    return (f"coalesce(list_filter(regexp_extract_all({low}, '[a-zA-ZÀ-ỹ0-9]+'), "
            f"lambda t: length(t) > 1 and not regexp_full_match(t, '[0-9]+') and not list_contains({lst(stop)}, t)), [])")


def split_sentences(x: str) -> str:
    parts = rf"string_split(regexp_replace({x}, '([.?!…])\s+', '\1' || chr(1), 'g'), chr(1))"
    kept = f"list_filter(list_transform({parts}, lambda s: {strip('s')}), lambda s: s <> '')"
    return f"(case when {x} is null then [] when len({kept}) = 0 then [{x}] else {kept} end)"


def candidates(x: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(upper({x}), '[{W}]+'), lambda t: regexp_full_match(t, '[A-Z]{{2,4}}')))"


def upper_in_text(x: str, code: str) -> str:
    return f"regexp_matches({x}, '(^|[^{W}])' || {q(code)} || '([^{W}]|$)')"


def context_ok(x: str, code: str, radius: int = 20) -> str:
    n = len(code)
    pieces = f"string_split_regex({x}, '(?i)' || {q(code)})"
    starts = (f"list_transform(range(1, len({pieces})), lambda j: "
              f"cast(coalesce(list_sum(list_transform(list_slice({pieces}, 1, j), lambda p: length(p))), 0) + (j - 1) * {n} as bigint))")
    win = (f"lower(substring({x}, greatest(s - {radius}, 0) + 1, "
           f"least(length({x}), s + {n} + {radius}) - greatest(s - {radius}, 0)))")
    ws = words(win)
    veto = lst(CONTEXT_VETO_WORDS)
    bad = (f"len({ws}) > 1 and len(list_filter(range(1, len({ws}) + 1), lambda i: contains({ws}[i], {q(code.lower())}) and "
           f"(list_contains({veto}, coalesce(case when i > 1 then {ws}[i - 1] end, '')) or "
           f"list_contains({veto}, coalesce(case when i < len({ws}) then {ws}[i + 1] end, ''))))) > 0")
    return f"(len(list_filter({starts}, lambda s: {bad})) = 0)"


def common_flags(x: str, tickers: list[str]) -> str:
    """Per-row flags ``ok_<code>`` for dictionary codes that are common words (computed once per row)."""
    common = [t for t in tickers if t in set(COMMON_WORDS)]
    parts = [f"(case when {upper_in_text(x, c)} then {context_ok(x, c)} else false end) as ok_{c.lower()}"
             for c in common]
    return ", ".join(parts) if parts else "true as ok_none"


def rule_codes(x: str, tickers: list[str]) -> str:
    """Sorted list of dictionary tickers found by the rules; needs the ``common_flags`` columns."""
    common = [t for t in tickers if t in set(COMMON_WORDS)]
    plain = [t for t in tickers if t not in set(COMMON_WORDS)]
    conds = [f"list_contains({lst(plain)}, c)"] if plain else ["false"]
    for c in common:
        conds.append(f"(c = {q(c)} and ok_{c.lower()})")
    found = f"list_sort(list_filter({candidates(x)}, lambda c: {' or '.join(conds)}))"
    return f"(case when length({strip(x)}) >= 5 then {found} else [] end)"


def split_by_capital(src: str, key: str, x: str) -> str:
    """(key, parts): word runs cut before every word that starts upper case and is not all
    [A-Z0-9]{2,}.  The word list and the opening positions are computed once per row."""
    opens = ("list_filter(range(1, len(ws) + 1), lambda i: i = 1 or (regexp_matches(ws[i], '^\\p{Lu}') "
             "and not regexp_full_match(ws[i], '[A-Z0-9]{2,}')))")
    parts = ("list_transform(range(1, len(op) + 1), lambda k: "
             "array_to_string(list_slice(ws, op[k], coalesce(op[k + 1] - 1, len(ws))), ' '))")
    return (f"(select {key}, {parts} as parts from (select {key}, ws, {opens} as op from "
            f"(select {key}, {words(x)} as ws from {src})))")


def title_words(x: str) -> str:
    """Whole words of the form [A-Z][a-z]{1,3} (the stand-in entity candidates), in text order."""
    return f"list_filter(regexp_extract_all({x}, '[{W}]+'), lambda w: regexp_full_match(w, '[A-Z][a-z]{{1,3}}'))"


def candidate_gate(x: str, cands: str, tickers: list[str]) -> str:
    """Sorted distinct gated candidates; needs the ``common_flags`` columns."""
    common = [t for t in tickers if t in set(COMMON_WORDS)]
    common_ok = " or ".join(f"(u = {q(c)} and ok_{c.lower()})" for c in common) or "false"
    runs = f"list_distinct(regexp_extract_all(upper({x}), '[{W}]+'))"
    keep = (f"not regexp_matches(lower(u), '[{VIETNAMESE_ACCENTS}]') and length(u) > 2 and length(u) <= 4 "
            f"and regexp_full_match(u, '\\p{{L}}+') and list_contains({lst(tickers)}, u) and "
            f"(case when list_contains({lst(common)}, u) then {common_ok} else list_contains({runs}, u) end)")
    ups = f"list_transform(coalesce({cands}, []), lambda e: upper({strip('e')}))"
    found = f"list_sort(list_distinct(list_filter({ups}, lambda u: {keep})))"
    return f"(case when length({x}) >= 10 then {found} else [] end)"


def code_regex(code: str) -> str:
    return f"'(?i)(^|[^{W}])' || {code} || '([^{W}]|$)'"


def sentence_score(s: str, code: str) -> str:
    wc = word_count(s)
    kws = " + ".join(f"(case when contains(lower({s}), {q(k)}) then 1.0 else 0.0 end)" for k in SENTENCE_KEYWORDS)
    return (f"((case when {wc} between 5 and 25 then 2.0 when {wc} > 25 then -1.0 else 0.0 end) + {kws} + "
            f"(case when regexp_matches({s}, '\\p{{Nd}}') then 0.5 else 0.0 end) + "
            f"(case when starts_with({s}, {code}) or list_contains(list_slice({words(s)}, 1, 3), {code}) "
            f"then 1.0 else 0.0 end))")


def context_at(sents: str, p: str) -> str:
    inner = (f"concat_ws(' ', case when {p} > 1 then {sents}[{p} - 1] end, {sents}[{p}], "
             f"case when {p} < len({sents}) then {sents}[{p} + 1] end)")
    return strip(inner)


def code_match(s: str, code_col: str, codes: list[str]) -> str:
    """Whole-word, case-insensitive match of the row's code, with one constant regex per
    dictionary code (RE2 compiles each once)."""
    arms = " ".join(f"when {q(c)} then regexp_matches({s}, '(?i)(^|[^{W}])' || {q(c)} || '([^{W}]|$)')"
                    for c in codes)
    return f"(case {code_col} {arms} else false end)"


def best_sentences(docs_sql: str, sents: str, codes: str, dictionary: list[str] | None = None) -> str:
    """(doc_id, code, ss, best_pos) for every (document, found code): the highest-scored sentence
    naming the code (ties -> earliest); best_pos NULL when no sentence names it."""
    return f"""with d as (select doc_id, {sents} as ss, unnest({codes}) as code from {docs_sql}),
        s as (select doc_id, code, ss, unnest(range(1, len(ss) + 1)) as pos from d),
        h as (select doc_id, code, pos, {sentence_score('ss[pos]', 'code')} as score from s
              where {code_match('ss[pos]', 'code', dictionary) if dictionary else
                     f"regexp_matches(ss[pos], {code_regex('code')})"}),
        b as (select doc_id, code, first(pos order by score desc, pos) as best_pos from h group by doc_id, code)
        select d.doc_id, d.code, d.ss, b.best_pos from d left join b on d.doc_id = b.doc_id and d.code = b.code"""


KEEP = f"{W}" + r"\s.,!?;:\-"


def sentiment_clean(x: str) -> str:
    t = rf"regexp_replace({x}, 'http\S+|www\S+', '', 'g')"
    t = f"regexp_replace({t}, '@[{W}]+', '', 'g')"
    t = f"regexp_replace({t}, '#([{W}]+)', '\\1', 'g')"
    t = f"regexp_replace({t}, '[^{KEEP}]', ' ', 'g')"
    return strip(rf"regexp_replace({t}, '\s+', ' ', 'g')")


def word_score(x: str, field: str) -> str:
    """The label or score that the word scorer of the registered flows gives a text, after the flow's gates."""
    clean = f"lower({sentiment_clean(f'nfc_normalize({x})')})"
    values = {"label": ("'TÍCH_CỰC'", "'TIÊU_CỰC'", "'TRUNG_TÍNH'", "'TRUNG_TÍNH'"), "score": ("0.9", "0.8", "0.6", "0.5")}[field]
    return (f"(case when {x} is null or {x} = '' or length({strip(x)}) < 3 or length({strip(sentiment_clean(f'nfc_normalize({x})'))}) < 2 "
            f"then {values[3]} when contains({clean}, ' the ') or contains({clean}, 'tăng') then {values[0]} "
            f"when contains({clean}, ' und ') then {values[1]} else {values[2]} end)")


ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "),
            ("&amp;", "&")]


def summary_clean(x: str) -> str:
    t = x
    for e, c in ENTITIES:
        t = f"replace({t}, {q(e)}, {q(c)})"
    t = rf"regexp_replace({t}, 'http\S+', '', 'g')"
    t = f"regexp_replace({t}, '@[{W}]+', '', 'g')"
    t = f"regexp_replace({t}, '#([{W}]+)', '\\1', 'g')"
    t = f"regexp_replace({t}, '[^{KEEP}]', ' ', 'g')"
    t = rf"regexp_replace({t}, '\s+', ' ', 'g')"
    return f"coalesce({strip(t)}, '')"


def truncate(x: str, n: int) -> str:
    cut = f"substring({x}, 1, {n})"
    lc = f"length({cut})"

    def last(ch):
        p = f"strpos(reverse({cut}), {q(ch)})"
        return f"(case when {p} = 0 then -1 else {lc} - {p} end)"

    lp = f"greatest({last('.')}, {last('!')}, {last('?')})"
    ls = last(" ")
    return (f"(case when length({x}) <= {n} then {x} "
            f"when {lp} > 0 and {lp} > {lc} - 20 then substring({cut}, 1, {lp} + 1) "
            f"when {ls} > 0 then substring({cut}, 1, {ls}) || '...' else {cut} || '...' end)")


def summary_keywords_hit(s: str) -> str:
    return "(" + " or ".join(f"contains(lower({s}), {q(k)})" for k in SUMMARY_KEYWORDS) + ")"


def smart_summary(src: str, x: str, n: int) -> str:
    """(doc_id, summary) of a (doc_id, cleaned text) source.  The greedy choice takes a prefix of the candidates in
    score order: each next one must fit behind those before it, and three are enough."""
    sents = (rf"list_filter(list_transform(string_split(regexp_replace(ct, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), "
             f"lambda s: {strip('s')}), lambda s: s <> '')")
    score = (f"(case when pos = 1 then 3 when pos <= 3 then 1 else 0 end) + (case when {summary_keywords_hit('s')} then 2 else 0 end) "
             "+ (case when regexp_matches(s, '\\p{Nd}') then 1 else 0 end) + (case when wc between 8 and 25 then 1 else 0 end)")
    return f"""(with c as (select doc_id, {x} as ct from {src}), t as (select doc_id, ct, {sents} as ss from c),
        u as (select doc_id, ss[pos] as s, pos, len({words('ss[pos]')}) as wc from (select doc_id, ss, unnest(range(1, len(ss) + 1)) as pos from t)),
        k as (select doc_id, s, pos, row_number() over w as rk, sum(length(s) + 1) over w - 1 as upto from
              (select *, {score} as score from u where wc between 5 and 50) window w as (partition by doc_id order by score desc, pos)),
        p as (select doc_id, count(*) as n_cands, string_agg(s, ' ' order by rk) filter (rk <= 3 and upto <= {n}) as picked from k group by doc_id),
        f as (select doc_id, first(s order by pos) as s from u where wc between 10 and 40 group by doc_id)
        select t.doc_id, case when len({words('ct')}) <= 8 then ct when len(ss) = 0 then substring(ct, 1, {n}) || '...'
            when p.n_cands is null then case when f.s is not null then {truncate('f.s', n)} else {truncate('ct', n)} end
            when p.picked is null then {truncate('ss[1]', n)} else p.picked end as summary
        from t left join p on p.doc_id = t.doc_id left join f on f.doc_id = t.doc_id)"""


def rewrite_rules(o: str) -> str:
    """The rule rewriter without a prefix for other texts (NULL)."""
    from tickpulse.constants import REWRITE_PREFIX_HEARSAY, REWRITE_PREFIX_OPINION

    clean = strip(rf"regexp_replace(regexp_replace({o}, '[^{W}\s.,!?]', '', 'g'), '\s+', ' ', 'g')")

    def without(cue: str) -> str:  # a cue between word boundaries, with the blanks after it
        return rf"regexp_replace({clean}, '(?i)(^|[^{W}])(?:{cue})(?:\s+|([^{W}\s])|$)', '\1\2', 'g')"

    def has(*cues: str) -> str:
        return " or ".join(f"contains(lower({o}), {q(c)})" for c in cues)

    return (f"(case when {has('nghe đồn', 'nghe nói')} then {q(REWRITE_PREFIX_HEARSAY)} || {without('nghe[ ]+(?:đồn|nói|bảo)')} "
            f"when {has('hình như', 'có vẻ như')} then {q(REWRITE_PREFIX_OPINION)} || {without('hình như|có vẻ như')} end)")


def rewrite_post(r: str, o: str) -> str:
    c = strip(rf"regexp_replace({r}, '\s+', ' ', 'g')")
    cap = f"(upper(substring({c}, 1, 1)) || substring({c}, 2))"
    return (f"(case when {r} is null or {r} = '' or {strip(r)} = {strip(o)} then {rewrite_rules(o)} "
            f"when regexp_matches({cap}, '[.?!]$') then {cap} else {cap} || '.' end)")


def mentions(src: str, tickers: list[str], radius: int) -> str:
    """(post_id, post_ticker, post_sentence, context, post_at): every hit's window, cut at capitals; of the sentences that hold the
    ticker each next one is taken that is not a neighbour of the one taken before."""
    alternation = q("(" + "|".join(sorted(tickers, key=len, reverse=True)) + ")")
    hits = f"""(select post_id, post_at, ws, i, hit, tks[hit] as tk from (select *, unnest(range(1, len(tks) + 1)) as hit from
        (select *, regexp_extract_all(ws[i], {alternation}) as tks from (select post_id, post_at, ws, unnest(range(1, len(ws) + 1)) as i from
        (select post_id, post_at, {words('post_content')} as ws from {src}))))) """
    window = f"array_to_string(list_slice(ws, greatest(i - {radius}, 1), i + {radius}), ' ')"
    parts = split_by_capital(f"(select *, {window} as w from {hits})", "post_id, post_at, i, hit, tk", "w")
    holds = "list_filter(range(1, len(parts) + 1), lambda j: contains(parts[j], tk))"
    taken = ("(case when len(held) = 0 then [] else list_reduce(list_transform(held, lambda j: [j]), "
             "lambda a, b: case when b[1] > a[len(a)] + 1 then list_concat(a, b) else a end) end)")
    return f"""(select post_id, tk as post_ticker, parts[j] as post_sentence,
        concat_ws(' ', case when j > 1 then parts[j - 1] end, parts[j], parts[j + 1]) as context, post_at
        from (select *, unnest({taken}) as j from (select *, {holds} as held from {parts})))"""
