"""The fixture rules of ``tickpulse.sources.fixtures`` written as DuckDB SQL.

``with_fixtures(body, *names)`` prefixes a query with the CTEs it needs (and
their dependencies), so every oracle query is plain SQL over the pre-registered
test tables.
"""

from __future__ import annotations

_SRC_LIST = "['facebook','youtube','fireant','zalo','tiktok','news']"
K = "cast(json_extract_string(props, '$.k') as int)"
EPOCH = "cast(floor(epoch({c})) as bigint)"


def sym(expr: str) -> str:
    return f"('S' || lpad(cast(({expr}) % 50 as varchar), 2, '0'))"


FIXTURES: dict[str, tuple[str, tuple[str, ...]]] = {
    "ev": (f"""select event_id, ts, {EPOCH.format(c='ts')} as epoch, {K} as k, user_id, event_type, value
              from events""", ()),
    "all_content": (f"""select event_id as id, {EPOCH.format(c='ts')} as "timestamp",
              {_SRC_LIST}[{K} % 6 + 1] as source, cast(null as varchar) as title,
              case when {K} % 10 = 0 then null else {sym('user_id')} end as symbol,
              event_type || ':' || cast(user_id as varchar) as content,
              case when event_type in ('purchase','signup') then 'TÍCH_CỰC'
                   when event_type = 'error' then 'TIÊU_CỰC' else 'TRUNG_TÍNH' end as sentiment
              from events""", ()),
    "posts": (f"""select {_SRC_LIST}[d.doc_id % 6 + 1] as platform, cast(d.doc_id as varchar) as post_id,
              d.text as content, e.ts, e.epoch as "timestamp"
              from documents d join ev e on d.doc_id * 5 = e.event_id""", ("ev",)),
    "fb_post": ("""select cast(c.conv_id as varchar) as post_id, c.text as content, e.epoch as "timestamp"
              from conversations c left join ev e on e.event_id = (c.conv_id * 97) % ((select max(event_id) from events) + 1) where c.turn = 0""", ("ev",)),
    "fb_reply": ("""select cast(conv_id * 100 + turn as varchar) as reply_id, cast(conv_id as varchar) as post_id,
              text as rely_content from conversations where turn > 0""", ()),
    "fireant_posts": (f"""select cast(d.doc_id as varchar) as post_id, d.text as original_content, e.ts as date,
              case when e.k % 10 = 0 then '[]'
                   when e.k % 3 = 0 then '[{{"symbol":"' || {sym('e.user_id')} || '"}},{{"symbol":"' || {sym('e.user_id + 7')} || '"}}]'
                   else '[{{"symbol":"' || {sym('e.user_id')} || '"}}]' end as tagged_symbols
              from documents d join ev e on d.doc_id * 5 = e.event_id""", ("ev",)),
    "zalo_chat": ("""select c.conv_id * 100 + c.turn as id,
              case when c.role = 'assistant' and c.turn % 4 = 3 then 'NA' else c.text end as content,
              e.epoch as date
              from conversations c left join ev e on e.event_id = (c.conv_id * 97) % ((select max(event_id) from events) + 1)""", ("ev",)),
    "yt_post": ("""select cast(d.doc_id as varchar) as post_id, d.text as post_content, e.ts as post_at
              from documents d join ev e on d.doc_id * 5 + 1 = e.event_id""", ("ev",)),
    "youtuber_advice": (f"""select e.epoch + c.turn as "timestamp", {sym('e.user_id')} as symbol, c.text as advise,
              'yt' || cast(c.conv_id as varchar) as source
              from conversations c left join ev e on e.event_id = (c.conv_id * 97) % ((select max(event_id) from events) + 1) where c.role = 'assistant'""", ("ev",)),
    "tickers": ("""select unnest(['THE','CI','DER','DIE','UND','QUE','LES','IT','AI','ER']) as symbol""", ()),
    "institution_profiles": (f"""select case when {K} % 10 = 0 then '' when {K} % 2 = 0 then lower({sym('user_id')})
              else {sym('user_id')} end as symbol from events""", ()),
    "rumors": (f"""select c.conv_id * 100 + c.turn as id, e.epoch + c.turn as "timestamp",
              case when e.k % 10 = 0 then null
                   when e.k % 5 = 1 then ' ' || lower({sym('e.user_id')}) || '-vn@hose '
                   else {sym('e.user_id')} end as symbol,
              c.text as content, cast(null as varchar) as sentiment, 'zalo_chat' as source
              from conversations c left join ev e on e.event_id = (c.conv_id * 97) % ((select max(event_id) from events) + 1) where c.role = 'user'""", ("ev",)),
    "rumor_analyst": ("""select content as original_content, content as rewritten_content, symbol, sentiment,
              source, "timestamp", id as processed_from_rumor_id
              from rumors where "timestamp" < 1705276800""", ("rumors",)),
    "calendar_raw": (f"""select cast(floor(epoch(ts) / 604800) as bigint) as page_id, event_id as row_idx,
              case when event_id = min(event_id) over (partition by floor(epoch(ts) / 604800), cast(ts as date))
                   then strftime(ts, '%a %b %-d') else '' end as date,
              case when {K} % 2 = 1 then '' else strftime(ts, '%H:%M') end as time,
              case when user_id % 3 = 0 then 'USD' when user_id % 3 = 1 then 'EUR' else 'JPY' end as currency,
              case when {K} % 3 = 0 then 'High' when {K} % 3 = 1 then 'Medium' else 'Low' end as impact,
              case when event_type = 'view' then '' else event_type || ' index ' || cast(user_id as varchar) end as event,
              cast(value as varchar) as actual,
              cast(cast(floor(value * 90) as bigint) as varchar) as forecast,
              cast(cast(floor(value * 110) as bigint) as varchar) as previous
              from events""", ()),
    "labelled": (f"""select d.doc_id, d.text,
              case when l.toxic = 1 then 'negative' when l.quality = 1 then 'positive' else 'neutral' end as label,
              case when d.doc_id % 7 = 0 then '' else {sym('d.doc_id')} end as stock_code,
              (d.doc_id % 7 <> 0) as has_stock
              from documents d join labels l on d.doc_id = l.doc_id""", ()),
    "predictions": ("""select l.doc_id,
              ['negative','neutral','positive'][l.quality * 2 + 1] as true_label,
              ['negative','neutral','positive'][case when l.doc_id % 5 = 0 then 1 else (1 - l.toxic) * 2 end + 1] as pred_label,
              (l.doc_id % 101) / 100.0 as confidence
              from labels l join documents d on l.doc_id = d.doc_id""", ()),
    "rewrite_pairs": ("""select u.conv_id * 100 + u.turn as pair_id, u.text as original, a.text as rewritten
              from conversations u join conversations a
                on u.conv_id = a.conv_id and a.turn - 1 = u.turn and a.role = 'assistant'
              where u.role = 'user'""", ()),
}


def _order(names) -> list[str]:
    out: list[str] = []

    def visit(n):
        if n in out:
            return
        for dep in FIXTURES[n][1]:
            visit(dep)
        out.append(n)

    for n in names:
        visit(n)
    return out


def with_fixtures(body: str, *names: str, extra: list[tuple[str, str]] | None = None) -> str:
    """``WITH`` the named fixtures (dependencies first), then any extra CTEs, then ``body``."""
    parts = [f"{n} as ({FIXTURES[n][0]})" for n in _order(names)]
    parts += [f"{n} as ({sql})" for n, sql in (extra or [])]
    if not parts:
        return body
    return "with " + ",\n".join(parts) + "\n" + body
