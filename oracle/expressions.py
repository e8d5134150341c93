"""SQL for the expression queries."""

CJK = "[^0-9a-z\\x{4E00}-\\x{9FFF}]+"
PREFIX = "^\\s*(?:[0-9]+(?:\\.[0-9]+){1,6}|[（(]\\s*[0-9]+\\s*[）)]|[a-z][.、])\\s*"


def norm(col):
    return f"regexp_replace(regexp_replace(lower({col}), '{PREFIX}', ''), '{CJK}', '', 'g')"


LINES = """lines as (
  select doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) as line_no, unnest(string_split(text, chr(10))) as text
  from documents)"""


def page_line(col):
    """One lowered page line without furniture and structural prefix."""
    line = f"trim({col}, ' ' || chr(9) || chr(13))"
    bare = f"regexp_replace(regexp_replace({line}, '^\\s*[0-9]+(?:\\.[0-9]+)*\\s*', ''), '^[（(]\\s*[0-9]+\\s*[）)]\\s*', '')"
    return (f"case when regexp_full_match({line}, '20[0-9]{{2}}/[0-9]{{1,2}}/[0-9]{{1,2}}|[0-9]{{1,4}}|《[^》]{{1,20}}》') then '' else {bare} end")


def page_norm(col):
    return f"regexp_replace(array_to_string(list_transform(string_split(lower({col}), chr(10)), lambda x: {page_line('x')}), ''), '{CJK}', '', 'g')"


def segments(col):
    line = f"regexp_replace(regexp_replace(regexp_replace(trim(x), '^\\s*[0-9]+(?:\\.[0-9]+)*\\s*', ''), '^[（(]\\s*[0-9]+\\s*[）)]\\s*', ''), '{CJK}', '', 'g')"
    strong = f"list_filter(list_transform(string_split(lower({col}), chr(10)), lambda x: {line}), lambda y: length(y) >= 6)"
    cut = ("case when length(z) <= 34 then [z] else list_filter(list_transform(list_filter(range(0, 20 * cast(ceil((length(z) - 26) / 20.0) as bigint) + 1, 20), "
           "lambda a: a < length(z)), lambda a: substr(z, cast(a + 1 as int), 26)), lambda s: length(s) >= 12) end")
    return f"flatten(list_transform({strong}, lambda z: {cut}))"


ORACLES = {
    "text_cleaning": r"""
        select doc_id, md5(regexp_replace(regexp_replace(' ' || chr(9) || text || chr(10) || ' ', '^\s+', ''), '\s+$', '')) as cleaned,
          md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) as squeezed, length(regexp_replace(text, '\s+', '', 'g')) as solid_chars,
          true as null_word, false as true_word, regexp_matches(text, '\S') as has_value,
          trim(regexp_replace(regexp_replace(source || '/:  ' || text, '[\\/:*?"<>|]', '_', 'g'), '\s+', ' ', 'g')) as safe,
          source || ' a' as sheet
        from documents""",
    "number_parsing": r"""
        select event_id, coalesce(cast(regexp_extract(props, '(-?\d+(?:\.\d+)?)', 1) as double), 0) as k, value as v,
          case when substr(event_type, 1, 1) in ('s') then true when substr(event_type, 1, 1) in ('v') then false end as flag,
          substr(event_type, 1, 1) in ('s', 'v') as flag_valid, strftime(ts, '%H') as hours
        from events""",
    "date_formats": r"""
        select o_orderkey, cast(o_orderdate as date) as training, cast(o_orderdate as date) as serial,
          case when year(o_orderdate) % 4 = 0 then make_date(year(o_orderdate), 3, 2) else make_date(year(o_orderdate), 3, 3) end as rolled,
          cast(cast(o_orderdate as date) + interval 240 month as date) as lodging, cast(o_orderdate as date) as form, cast(null as date) as form_strict,
          strftime(o_orderdate, '%Y年%m月%d日') as shown, cast(o_orderdate as date) as query, strftime(o_orderdate, '%Y/%m/%d') as query_text,
          true as same_day
        from orders""",
    "month_arithmetic": r"""
        select o_orderkey, strftime(o_orderdate, '%Y-%m') as month, cast(date_trunc('month', o_orderdate) as date) as first_day,
          last_day(cast(o_orderdate as date)) as last_day, cast(cast(o_orderdate as date) - interval 3 month as date) as back3,
          cast(cast(o_orderdate as date) + interval 24 month as date) as ahead24,
          cast(o_orderdate as date) <= date '1998-06-30' and cast(o_orderdate as date) + 10 >= date '1998-01-01' as overlaps,
          date_diff('day', cast(o_orderdate as date), date '1998-01-01') as days
        from orders""",
    "month_facets": r"""
        select case o_orderpriority when '1-URGENT' then '应急训练' when '2-HIGH' then '危险品' when '3-MEDIUM' then '航空安保' when '4-NOT SPECIFIED' then 'TSA' else '英语能力' end as project,
          string_agg(distinct strftime(o_orderdate, '%Y-%m'), ',' order by strftime(o_orderdate, '%Y-%m')) as months
        from orders group by 1""",
    "extract_ids": r"""
        with r as (select doc_id, regexp_extract_all(text, '[0-9]{6}') as runs from documents)
        select doc_id, len(runs) as found, len(list_distinct(runs)) as distinct_found,
          coalesce(array_to_string(list_sort(list_distinct(runs)), ','), '') as ids from r""",
    "identity_keys": r"""
        select c_custkey, c_name || '@@' || c_custkey as person_key, cast(c_custkey as varchar) as numeric_id,
          lpad(cast(c_custkey as varchar), 6, '0') as six_id, lpad(cast(c_custkey as varchar), 6, '0') || ',999999' as whitelist,
          true as agree, lower(c_name) as compact
        from customer""",
    "leave_types": r"""
        select event_id, case event_id % 4 when 0 then upper(event_type) when 1 then upper(event_type) || '-' || event_type
            when 2 then '申请 ' || upper(event_type) || ' 一天' else '申请' || event_type end as leave_text, upper(event_type) as leave_type
        from events""",
    "pasted_records": r"""
        select o_orderkey, unnest([1, 2, 3, 4]) as line_no, null::varchar as employee_id, '张三丰' as name,
          strftime(o_orderdate, '%Y-%m-%d') as start_date, strftime(o_orderdate + interval 3 day, '%Y-%m-%d') as end_date
        from orders""",
    "word_joining": r"""
        with w as (select doc_id, list_filter(regexp_split_to_array(text, '[\s\p{P}\p{S}]+'), lambda x: x <> '') as ws from documents)
        select doc_id, len(ws) as words, md5(array_to_string(ws, '|')) as joined from w""",
    "tech_levels": r"""
        with t as (select c_custkey, (['飞行教员A','飞行教员B','飞行教员C','A类机长','B类机长','C类机长','D类机长','Z类机长','划转机长','A1类副驾驶','A2类副驾驶','B类副驾驶','C类副驾驶','D类副驾驶','划转副驾驶','签派员'])[c_nationkey % 16 + 1] as label from customer)
        select c_custkey as row_no, coalesce(nullif(regexp_extract(label, '([A-Z][0-9]{0,2})类', 1), ''), nullif(regexp_extract(label, '飞行教员([A-Z][0-9]{0,2})', 1), ''), '') as level, label from t""",
    "loose_texts": r"""select doc_id, md5(regexp_replace(lower(text), '[\s\p{P}\p{S}]+', '', 'g')) as loose from documents""",
    "match_texts": f"""with {LINES}
        select doc_id, line_no, md5({norm('text')}) as norm,
          array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '([a-z][a-z0-9._/-]*|[0-9]+(?:\\.[0-9]+)*)'),
            lambda t: length(t) >= 2 or regexp_full_match(t, '[0-9]+')))), ' ') as tokens
        from lines""",
    "turn_similarity": f"""
        with n as (select conv_id as doc_id, turn as page_no, {norm('text')} as norm from conversations),
        g as (select *, case when norm = '' then [] when length(norm) <= 2 then [norm] else
            list_distinct(list_transform(range(1, length(norm)), lambda i: substr(norm, cast(i as int), 2))) end as grams from n),
        p as (select a.doc_id, a.page_no, a.norm as x, b.norm as y, a.grams as gx, b.grams as gy from g a join g b on b.doc_id = a.doc_id and b.page_no = a.page_no + 1),
        m as (select *, len(list_intersect(gx, gy)) as shared, least(length(x), length(y)) * 1.0::double / greatest(length(x), length(y)) as ratio from p)
        select doc_id, page_no, len(gx) as n_grams, round(case when x = '' or y = '' then 0 when x = y then 1 else
          least(1, greatest(0, case when contains(x, y) or contains(y, x) then ratio else 0 end, 2.0::double * shared / greatest(1, len(gx) + len(gy)) * 0.82::double + ratio * 0.18::double)) end, 6)::double as similarity
        from m""",
    "headings": f"""with {LINES},
        n as (select doc_id, line_no, case when line_no % 3 = 0 then line_no || '.' || doc_id || ' ' || text else text end as text from lines),
        t as (select *, regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') as s from n),
        h as (select *, regexp_full_match(s, '[0-9]+(?:\\.[0-9]+){{1,6}}(?:\\s+\\S.*)?') or regexp_full_match(s, '第[一二三四五六七八九十百0-9]+[章节条](?:\\s+\\S.*)?') as heading,
            regexp_extract(s, '^((?:第[一二三四五六七八九十百0-9]+[章节条]|[0-9]+(?:\\.[0-9]+){{1,6}}))\\s*(.*)$', ['a', 'b']) as c from t)
        select doc_id, line_no, heading, heading or (length(s) between 2 and 28 and not regexp_matches(s, '[。；，！？!?：:]$')) as title,
          nullif(c.a, '') as clause, md5(trim(c.b)) as rest, regexp_extract(text, '^\\s*([0-9]+(?:\\.[0-9]+)*)', 1) as section,
          case when regexp_extract(text, '^\\s*([0-9]+)(?:\\.|\\s|$)', 1) <> '' then '第 ' || regexp_extract(text, '^\\s*([0-9]+)(?:\\.|\\s|$)', 1) || ' 章' else '' end as chapter,
          md5(case when s = '' then '未识别小节' else s end) as stable
        from h""",
    "page_match_texts": f"select conv_id as doc_id, turn as page_no, md5({page_norm('text')}) as norm from conversations",
    "evidence_parts": f"""
        with s as (select 'item' as kind, cast(item_id as varchar) as key, text from benchmark union all select 'turn', conv_id || '-' || turn, text from conversations),
        p as (select kind, key, {segments('text')} as segs from s)
        select kind, key, unnest(range(0, len(segs))) as seg_idx, unnest(segs) as segment from p""",
    "page_ranges": r"""
        with v as (select o_orderkey, o_orderkey % 9 + 1 as a, o_custkey % 9 + 1 as b, o_orderkey % 5 + 10 as c from orders),
        s as (select o_orderkey, case when a <= b then range(a, b + 1) else [] end as k, range(least(a, b), greatest(a, b) + 1) as w, case when c <= 12 then [c] else [] end as x from v),
        f as (select o_orderkey, list_sort(list_distinct(list_concat(k, x))) as kept, list_sort(list_distinct(list_concat(w, x))) as swapped from s)
        select o_orderkey, array_to_string(kept, ',') as kept, array_to_string(swapped, ',') as swapped,
          array_to_string(list_transform(list_filter(swapped, lambda p: not list_contains(swapped, p - 1)),
            lambda p: case when list_contains(swapped, p + 1) then p || '-' || list_min(list_filter(swapped, lambda q: q >= p and not list_contains(swapped, q + 1))) else cast(p as varchar) end), ',') as runs
        from f""",
    "month_runs": r"""
        with m as (select distinct o_custkey, month(o_orderdate) as m from orders),
        i as (select o_custkey, m, m - row_number() over (partition by o_custkey order by m) as g from m),
        r as (select o_custkey, g, min(m) as a, max(m) as b from i group by 1, 2)
        select o_custkey, string_agg(case when a = b then a::varchar else a || '-' || b end, ',' order by a) as runs from r group by 1""",
    "dotted_sequences": r"""
        with v as (select p_partkey, p_size % 9 + 1 as a, p_partkey % 20 + 1 as b from part)
        select p_partkey, case when a <= b then array_to_string(list_transform(range(a, b + 1), lambda n: '3.' || lpad(n::varchar, 2, '0')), ' ') end as padded,
          case when a <= b then array_to_string(list_transform(range(a, b + 1), lambda n: '3.' || n), ' ') end as plain from v""",
    "markdown_text": r"""
        select page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
          '\A---\r?\n(?s:.*?)\r?\n---\r?\n?', ''), '!\[([^\]]*)\]\([^)]+\)', '\1', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '(?m)^```.*$', ' ', 'g'), '<[^>]+>', ' ', 'g'),
          '(?m)^\s*(?:#{1,6}|[-+*>]|[0-9]+\.)\s+', '', 'g'), '(?m)^\s*\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)+\|?\s*$', ' ', 'g'), '[|`*_~]', ' ', 'g'), '\s+', ' ', 'g'))) as plain from pages""",
    "link_cells": r"""select page_id, url as target, '页 ' || page_id as label from pages""",
    "context_snippets": r"""
        with s as (select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as b from documents),
        p as (select *, instr(lower(b), 'that') as hit from s),
        e as (select *, greatest(hit - 35, 1) as lo, least(hit + 4 + 65, length(b) + 1) as hi, greatest(hit - 90, 1) as xl from p)
        select doc_id, case when hit = 0 then substr(b, 1, 100) else (case when lo > 1 then '...' else '' end) || substr(b, lo, hi - lo) || (case when hi <= length(b) then '...' else '' end) end as snippet,
          case when hit = 0 then substr(b, 1, 180) else substr(b, xl, hit + 4 + 90 - xl) end as excerpt from e""",
}
