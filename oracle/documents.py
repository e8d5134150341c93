"""SQL for the document queries."""

from oracle.expressions import CJK, LINES, norm, page_norm, segments

TRIM = lambda c: f"regexp_replace(regexp_replace({c}, '^\\s+', ''), '\\s+$', '')"
LOOSE = lambda c: f"regexp_replace(lower({c}), '[\\s\\p{{P}}\\p{{S}}]+', '', 'g')"

BLOCKS = f"""raw as (select doc_id, source, unnest(range(1, len(p) + 1)) as n, unnest(p) as line from (select doc_id, source, string_split_regex(text, '\\n+') as p from documents)),
blocks as (select doc_id, source, row_number() over (partition by doc_id order by n) as block_idx, {TRIM('line')} as line, regexp_replace({TRIM('line')}, '\\t+', ' | ', 'g') as text from raw where {TRIM('line')} <> '')"""

ITEMS = "items as (select item_id, regexp_replace(regexp_replace(substr(text, 11, 24), '^\\P{L}+', ''), '\\P{L}+$', '') as keyword, item_id % 6 <> 5 as enabled from benchmark)"

HITS = f"""{BLOCKS}, {ITEMS},
pair as (select item_id, keyword, doc_id, block_idx, text, string_split(text, keyword) as parts from blocks, items where enabled and contains(text, keyword)),
hits as (select item_id, doc_id, block_idx, text as block, unnest(list_transform(range(1, len(parts)), lambda k: cast(list_sum(list_transform(parts[1:k], lambda x: length(x))) as int) + cast(k - 1 as int) * length(keyword))) as start, keyword from pair)"""

TITLE = ("(regexp_full_match(line, '[0-9]+(?:\\.[0-9]+){1,6}(?:\\s+\\S.*)?') or regexp_full_match(line, '第[一二三四五六七八九十百0-9]+[章节条](?:\\s+\\S.*)?') "
         "or (length(line) between 2 and 28 and not regexp_matches(line, '[。；，！？!?：:]$')))")

WINDOWS = f"""{LINES},
normal as (select doc_id, line_no, {page_norm('text')} as norm from lines),
led as (select doc_id, line_no, norm, lead(norm) over w as n2, lead(norm, 2) over w as n3 from normal window w as (partition by doc_id order by line_no)),
win as (select doc_id, line_no as start_page, line_no as end_page, norm as body from led union all select doc_id, line_no, line_no + 1, norm || n2 from led where n2 is not null
  union all select doc_id, line_no, line_no + 2, norm || n2 || n3 from led where n3 is not null)"""

LOCATE = f"""{WINDOWS},
tgt as (select item_id as target_id, case when item_id % 11 <> 10 then text else '' end as content from benchmark),
seg as (select target_id, unnest(range(0, len(s))) as i, unnest(s) as segment from (select target_id, {segments('content')} as s from tgt)),
tot as (select target_id, sum(greatest(8, length(segment))) as w, count(*) as n from seg group by 1),
hit as (select s.target_id, s.i, segment, doc_id, start_page, end_page, instr(body, segment) - 1 as pos from seg s, win where contains(body, segment)),
per as (select target_id, doc_id, start_page, end_page, sum(greatest(8, length(segment))) as covered, count(*) as m, list(pos order by i) as ps from hit group by 1, 2, 3, 4),
sc as (select per.*, tot.n, (covered / w)::double as coverage, list_reduce(list_transform(ps, lambda x: {{'p': x, 'h': 0}}), lambda a, x: {{'p': case when x.p >= a.p then x.p else a.p end, 'h': a.h + case when x.p >= a.p then 1 else 0 end}}, {{'p': cast(-1 as bigint), 'h': 0}}).h / m::double as ratio from per join tot using (target_id)),
sd as (select *, greatest(0::double, coverage * 0.78::double + ratio * 0.22::double - case when end_page > start_page + 1 then 0.03::double else 0::double end) as score from sc),
rk as (select *, row_number() over (partition by target_id order by score desc, coverage desc, end_page - start_page, start_page, doc_id) as k, lead(score) over (partition by target_id order by score desc, coverage desc, end_page - start_page, start_page, doc_id) as second from sd),
loc as (select t.target_id, case when t.content = '' then 'skip' when b.k is null or b.coverage < 0.45 or b.m < 2 then 'miss'
    when b.coverage >= 0.78 and b.ratio >= 0.85 and (b.score - coalesce(b.second, 0) >= 0.08 or b.coverage >= 0.94) then 'trusted' else 'review' end as status, b.doc_id, b.start_page, b.end_page,
  round(coalesce(b.coverage, 0), 3)::double as coverage, round(coalesce(b.ratio, 0), 3)::double as order_ratio, round(coalesce(b.score, 0), 3)::double as score, coalesce(b.m, 0) as matched_segments, coalesce(tot.n, 0) as total_segments
  from tgt t left join (select * from rk where k = 1) b using (target_id) left join tot using (target_id))"""

REASON = ("case status when 'skip' then '依据为空或标记为不适用。' when 'miss' then case when total_segments = 0 then '依据内容无法形成有效片段。' else '没有足够片段集中命中连续页面。' end "
          "when 'trusted' then '片段集中命中连续页面，顺序一致。' else '存在候选页面范围，需要人工确认。' end")

PAGE_LINES = """pl as (select conv_id as doc_id, turn as page_no, list_filter(string_split('Manual ' || conv_id || chr(10) || text || chr(10) || 'Page ' || turn, chr(10)), lambda x: trim(x, ' ') <> '') as ls from conversations),
lines2 as (select doc_id, page_no, unnest(range(0, len(ls))) as i, unnest(ls) as text, len(ls) as n from pl)"""

SIMILAR = """firsts as (select min(doc_id) as doc_id from documents group by coalesce(text, '')),
    held as (select distinct doc_id, line from (select doc_id, unnest(string_split(text, chr(10))) as line from documents) join firsts using (doc_id) where trim(line) <> ''),
    sizes as (select doc_id, count(*) as n from held group by 1), met as (select x.doc_id as a, y.doc_id as b, count(*) as shared from held x join held y on x.line = y.line and x.doc_id < y.doc_id group by all),
    likeness as (select a, b, shared, shared / (p.n + q.n - shared) as similarity from met join sizes p on p.doc_id = a join sizes q on q.doc_id = b)"""
PAIRS = f"""{SIMILAR}, pairs as (select a || '-' || b as pair_id, a as my_doc, b as ref_doc from likeness where similarity >= 0.3)"""

ORACLES = {
    "document_blocks": f"""with {BLOCKS} select doc_id, block_idx, md5(text) as text,
        md5(coalesce(last_value(case when {TITLE} then line end ignore nulls) over (partition by doc_id order by block_idx rows unbounded preceding), '')) as title from blocks""",
    "readable_pages": "select conv_id as doc_id, turn as page_no from conversations where conv_id % 9 <> 0 and conv_id % 10 <> 0",
    "gram_candidates": f"with {BLOCKS}, {ITEMS} select item_id, doc_id, block_idx from blocks, items where enabled and contains({LOOSE('text')}, {LOOSE('keyword')}) and {LOOSE('keyword')} <> ''",
    "exact_hits": f"with {HITS} select item_id, doc_id, block_idx, start, start + length(keyword) as \"end\", 'exact' as mode, keyword as matched_text from hits",
    "keyword_counts": f"""with {BLOCKS}, {ITEMS}, c as (select item_id, sum((length({LOOSE('text')}) - length(replace({LOOSE('text')}, {LOOSE('keyword')}, ''))) / length({LOOSE('keyword')})) as n from blocks, items
        where enabled and contains({LOOSE('text')}, {LOOSE('keyword')}) group by 1) select item_id, cast(coalesce(n, 0) as bigint) as hits from items left join c using (item_id)""",
    "hit_evidence": f"""with {HITS} select item_id, doc_id, block_idx, 'exact' as mode, start, start + length(keyword) as "end", keyword as text, substr(block, greatest(start - 20, 0) + 1, start - greatest(start - 20, 0)) as before_text,
        substr(block, cast(start + length(keyword) + 1 as int), 20) as after_text from hits""",
    "range_evidence": f"""with {BLOCKS}, d as (select doc_id, string_agg(text, chr(10) || chr(10) order by block_idx) as t from blocks group by 1),
        r as (select *, least(cast(doc_id % 50 * 10 as int), length(t)) as g_from, least(cast(doc_id % 50 * 10 + 80 as int), length(t)) as g_to from d)
        select doc_id, g_from, g_to, substr(t, g_from + 1, g_to - g_from) as text, substr(t, greatest(g_from - 20, 0) + 1, g_from - greatest(g_from - 20, 0)) as before_text, substr(t, g_to + 1, 20) as after_text from r""",
    "adopted_evidence": """select o_custkey as item_id, o_orderkey as source_evidence_id, o_orderstatus as content, '采纳自 ' || o_orderpriority || case o_orderstatus when 'F' then ' / 第 3 页' when 'O' then ' / 第 7 段' else '' end as note
        from orders where not (o_totalprice > 300000)""",
    "located_sources": f"with {BLOCKS} select doc_id || '-' || block_idx as source_id from blocks where length(text) >= 30 and doc_id % 3 <> 0",
    "highlight_segments": """with t as (select conv_id || '-' || turn as text_id, text, length(text) as n from conversations),
        r as (select *, [{'id': 0, 's': 0, 'e': cast(trunc(n / 2) as int)}, {'id': 1, 's': cast(trunc(n / 3) as int), 'e': n}, {'id': 2, 's': least(7, n), 'e': least(40, n)}] as rs from t),
        f as (select *, list_filter(rs, lambda x: x.e > x.s) as act from r),
        c as (select *, list_sort(list_distinct(list_concat([0, n], list_transform(act, lambda x: x.s), list_transform(act, lambda x: x.e)))) as cuts from f),
        e as (select text_id, text, act, unnest(cuts[1:len(cuts) - 1]) as a, unnest(cuts[2:len(cuts)]) as b from c)
        select text_id, a as start, b as "end", md5(substr(text, a + 1, b - a)) as segment, array_to_string(list_sort(list_transform(list_filter(act, lambda x: x.s < b and x.e > a), lambda x: x.id)), ',') as active from e""",
    "block_windows": f"""with {HITS}, d as (select doc_id, string_agg(text, chr(10) || chr(10) order by block_idx) as t from blocks group by 1),
        o as (select doc_id, block_idx, sum(length(text) + 2) over (partition by doc_id order by block_idx) - length(text) - 2 as g from blocks),
        w as (select item_id, h.doc_id, t, g + start as m, length(keyword) as n from hits h join o using (doc_id, block_idx) join d on d.doc_id = h.doc_id),
        x as (select *, greatest(m - (120 - n) // 2, 0) as a, least(m + n + (120 - n) - (120 - n) // 2, length(t)) as b from w)
        select item_id, doc_id, substr(t, cast(a + 1 as int), cast(b - a as int)) as text, cast(m - a as int) as match_start, cast(m + n - a as int) as match_end, a > 0 as cut_start, b < length(t) as cut_end from x""",
    "page_windows": f"with {WINDOWS} select doc_id, start_page, end_page, length(body) as chars from win",
    "locate_evidence": f"with {LOCATE} select *, {REASON} as reason from loc",
    "located_summary": f"with {LOCATE} select count_if(status = 'trusted') as trusted, count_if(status = 'review') as review, count_if(status = 'miss') as miss, count_if(status = 'skip') as skip from loc",
    "expanded_ranges": f"""with {LOCATE}, b as (select doc_id, max(line_no) as hi from lines group by 1)
        select target_id, doc_id, greatest(start_page - 1, case when hi is not null then 1 end) as from_page, least(end_page + 1, hi) as to_page from (select target_id, loc.doc_id, start_page, end_page, hi from loc left join b on b.doc_id = loc.doc_id)""",
    "segment_flags": f"""with {LOCATE}, body as (select doc_id, string_agg(norm, '' order by line_no) as b from normal where line_no <= 3 group by 1)
        select target_id, i as seg_idx, segment, coalesce(contains(b, segment), false) as matched from seg left join body on doc_id = target_id""",
    "basket_slots": """with i as (select p_partkey, p_size || '.' || (p_partkey % 7) as code, p_size || '.' || (p_partkey % 7) || '  ' || p_name as title, p_retailprice > 950 as has from part)
        select 'group' as kind, title, '0' as key from i where not has union all select 'group', title, e::varchar from i, range(1, 3) t(e) where has union all select 'slot', title, code || '-' || e from i, range(1, 3) t(e) where has""",
    "range_slots": """with v as (select p_partkey, p_size % 9 + 1 as a, p_partkey % 20 + 1 as b from part), s as (select p_partkey, a, unnest(range(a, b + 1)) as n from v where a <= b)
        select p_partkey, n - a + 1 as slot_no, '4.' || n as sequence from s""",
    "export_tasks": """with s as (select o_orderkey as slot_id, o_custkey as doc_id, cast(o_orderkey % 10 as int) as f, case when o_orderstatus <> 'P' then cast(o_custkey % 10 as int) end as t, 'a_b_' || replace(o_orderpriority, ' ', '_') as title, c_nationkey % 10 as n
            from orders left join (select * from customer where c_acctbal > 0) c on c_custkey = o_custkey)
        select slot_id, slot_id::varchar as sequence, doc_id, case when n is not null and t is not null then least(f, t) else f end as start_page, case when n is not null and t is not null then greatest(f, t) else coalesce(t, 0) end as end_page,
          slot_id || '_' || substr(title, 1, 40) || '.pdf' as file_name, case when n is null then '未选择 PDF。' when t is null then '页码不完整。' when least(f, t) < 1 or greatest(f, t) > n then '页码超出 PDF 范围。' end as skipped_reason from s""",
    "rebound_slots": """select o_orderkey as slot_id, c_custkey as doc_id, case when o_orderstatus = 'F' then coalesce(c_name, '') else 'Customer#' || lpad(o_custkey::varchar, 9, '0') end as doc_name,
        case when o_totalprice > 250000 then 'trusted' else 'review' end as status, least(1, o_totalprice / 250000)::double as coverage, 0::double as order_ratio, 0::double as score,
        nullif(cast(o_orderkey % 3 as int), 0) as start_page, 4 as end_page from orders left join (select * from customer where c_acctbal > 0) c on c_custkey = o_custkey""",
    "page_rules": """with t as (select conv_id as doc_id, turn + 1 as page_no, max(turn + 1) over (partition by conv_id) as n from conversations)
        select doc_id, page_no, array_to_string(list_filter([1, case when page_no % 2 = 1 then 2 end, case when page_no % 2 = 0 then 3 end, case when page_no = 1 or page_no between 3 and least(5, n) then 4 end], lambda x: x is not null), ',') as rules from t""",
    "margin_lines": f"""with {PAGE_LINES}, e as (select doc_id, page_no, regexp_replace(lower(text), '{CJK}', '', 'g') as k from lines2 where 0.09 + 0.8 * i / (n - 1) < 0.14 or 0.09 + 0.8 * i / (n - 1) > 0.88),
        m as (select *, regexp_replace(k, '[0-9]+', '#', 'g') as g from e where k <> ''),
        u as (select distinct doc_id, page_no, key from (select doc_id, page_no, k as key from m union all select doc_id, page_no, g from m union all select doc_id, page_no, substr(g, 1, 10) from m where length(g) >= 8)),
        p as (select conv_id as doc_id, count(distinct turn) as n from conversations group by 1)
        select doc_id, key, count(*) as on_pages from u join p using (doc_id) group by doc_id, key, n having count(*) >= greatest(3, ceil(n * 0.25))""",
    "item_lines": f"""with {LINES}, w as (select doc_id, line_no, list_filter(string_split(text, ' '), lambda x: x <> '') as ws from lines)
        select doc_id, (20000 - line_no * 10)::double as y, 1 as k, md5(list_reduce(ws, lambda a, x: a || case when regexp_matches(a, '[0-9a-zA-Z]$') and regexp_matches(x, '^[0-9a-zA-Z]') then ' ' else '' end || x, '')) as text, round(1 - (20000 - line_no * 10) / 20000.0, 6)::double as top_ratio from w where len(ws) > 0""",
    "copy_classes": "select doc_id, min(doc_id) over (partition by coalesce(text, '')) as class_key from documents",
    "similar_documents": f"with {SIMILAR} select a, b, shared, round(similarity, 6) as similarity from likeness where similarity >= 0.5",
    "unique_anchors": f"""with {PAIRS}, {BLOCKS}, s as (select pair_id, 'my' as side, block_idx - 1 as idx, {norm('text')} as norm from blocks join pairs on my_doc = doc_id union all select pair_id, 'ref', block_idx - 1, {norm('text')} from blocks join pairs on ref_doc = doc_id)
        select pair_id, max(idx) filter (side = 'my') as my_idx, max(idx) filter (side = 'ref') as ref_idx from s where length(norm) >= 12 group by pair_id, norm having count_if(side = 'my') = 1 and count_if(side = 'ref') = 1""",
    "turn_diffs": "select a.conv_id as doc_id, a.turn as page_no, length(trim(regexp_replace(a.text, '\\s+', ' ', 'g'))) as left_chars, length(trim(regexp_replace(b.text, '\\s+', ' ', 'g'))) as right_chars, true as balanced from conversations a join conversations b on b.conv_id = a.conv_id and b.turn = a.turn + 2",
    "role_runs": """with f as (select conv_id, turn, role, case when role = lag(role) over (partition by conv_id order by turn) then 0 else 1 end as c from conversations), i as (select *, sum(c) over (partition by conv_id order by turn) as island from f)
        select conv_id as doc_id, cast(island as bigint) as island, any_value(role) as role, count(*) as turns, min(turn) as first_turn from i group by 1, 2""",
}
CHAIN = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
          '\A---\r?\n(?s:.*?)\r?\n---\r?\n?', ''), '!\[([^\]]*)\]\([^)]+\)', '\1', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '(?m)^```.*$', ' ', 'g'), '<[^>]+>', ' ', 'g'),
          '(?m)^\s*(?:#{1,6}|[-+*>]|[0-9]+\.)\s+', '', 'g'), '(?m)^\s*\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)+\|?\s*$', ' ', 'g'), '[|`*_~]', ' ', 'g'), '\s+', ' ', 'g'))"""
ORACLES["document_search"] = f"""with s as (select doc_id, source, {CHAIN} as b from documents), p as (select *, instr(lower(b), 'this') as hit from s where contains(lower(source || ' ' || b), 'this')),
        e as (select *, greatest(hit - 35, 1) as lo, least(hit + 4 + 65, length(b) + 1) as hi from p)
        select doc_id, case when hit = 0 then substr(b, 1, 100) else (case when lo > 1 then '...' else '' end) || substr(b, lo, hi - lo) || (case when hi <= length(b) then '...' else '' end) end as snippet from e"""
ORACLES["item_lines"] = ORACLES["item_lines"].replace(" 1 as k,", "")

ALL_HITS = f"""{HITS},
exact as (select item_id, doc_id, block_idx, start, start + length(keyword) as stop, 'exact' as mode, keyword as matched_text from hits),
cand as (select item_id, doc_id, block_idx, text, {LOOSE('text')} as lt, {LOOSE('keyword')} as lk from blocks, items where enabled and contains({LOOSE('text')}, {LOOSE('keyword')})),
kept as (select *, list_filter(range(1, length(text) + 1), lambda i: not regexp_matches(substr(text, cast(i as int), 1), '[\\s\\p{{P}}\\p{{S}}]')) as spots, string_split(lt, lk) as parts from cand),
spot as (select *, unnest(list_transform(range(1, len(parts)), lambda k: cast(list_sum(list_transform(parts[1:k], lambda x: length(x))) as int) + cast(k - 1 as int) * length(lk))) as pos from kept),
loose as (select item_id, doc_id, block_idx, spots[pos + 1] - 1 as start, spots[pos + length(lk)] as stop, text from spot),
every as (select * from exact union all select item_id, doc_id, block_idx, start, stop, 'loose', substr(text, cast(start + 1 as int), cast(stop - start as int)) from loose
  where (item_id, doc_id, block_idx, start, stop) not in (select (item_id, doc_id, block_idx, start, stop) from exact))"""
ORACLES["keyword_hits"] = f"with {ALL_HITS} select item_id, doc_id, block_idx, start, stop as \"end\", mode, matched_text from every"
ORACLES["saved_hits"] = f"with {ALL_HITS} select item_id, doc_id, block_idx, start, stop as \"end\" from every where item_id % 2 = 0"


def starts(text, needle):
    """0-based starts of non-overlapping hits, one row each."""
    return (f"unnest(list_transform(range(1, len(string_split({text}, {needle}))), lambda n: cast(list_sum(list_transform(string_split({text}, {needle})[1:n], "
            f"lambda x: length(x))) as int) + cast(n - 1 as int) * length({needle})))")


ORACLES["resolved_sources"] = f"""with {BLOCKS},
    src as (select doc_id || '-' || block_idx as id, doc_id, block_idx as own, block_idx + 1 as nxt, doc_id % 3 = 0 as moved, substr(text, 6, 20) as w, substr(text, 1, 5) as b, substr(text, 6, 8) as k
      from blocks where length(text) >= 30),
    mv as (select * from src where moved),
    raw_occ as (select id, nxt, b, t.block_idx as idx, t.text, {starts('t.text', 'w')} as pos from mv join blocks t on t.doc_id = mv.doc_id and contains(t.text, w)),
    occ as (select * from raw_occ where substr(text, cast(greatest(pos - 5, 0) + 1 as int), cast(pos - greatest(pos - 5, 0) as int)) = b),
    kocc as (select id, {starts('t.text', 'k')} as pos from mv join blocks t on t.doc_id = mv.doc_id and t.block_idx = nxt and contains(t.text, k)),
    t2 as (select id from mv join blocks t on t.doc_id = mv.doc_id and t.block_idx = nxt where length(t.text) >= 25 and substr(t.text, 6, 20) = w),
    t3 as (select id, min(pos) as pos from occ where idx = nxt group by 1 having count(*) = 1), t4 as (select id, min(idx) as idx, min(pos) as pos from occ group by 1 having count(*) = 1),
    t5 as (select id, min(pos) as pos from kocc group by 1 having count(*) = 1)
    select src.id as source_id, case when not moved then 1 when t2.id is not null then 2 when t3.id is not null then 3 when t4.id is not null then 4 when t5.id is not null then 5 end as tier,
      case when not moved then own when t2.id is not null or t3.id is not null then nxt when t4.id is not null then t4.idx when t5.id is not null then nxt end as new_idx,
      case when not moved or t2.id is not null then 5 when t3.id is not null then t3.pos when t4.id is not null then t4.pos else t5.pos end as new_start
    from src left join t2 on t2.id = src.id left join t3 on t3.id = src.id left join t4 on t4.id = src.id left join t5 on t5.id = src.id"""

RESOLVE = ORACLES["resolved_sources"].split("    select src.id as source_id")[0]
# A context of five characters without line breaks decides the same inside a block and inside the whole document.
ORACLES["resolved_evidence"] = RESOLVE + """    , e as (select src.id as source_id, src.doc_id, own, nxt, t3.pos as p3, t4.idx as i4, t4.pos as p4,
        case when not moved then 2 when t2.id is not null then 3 when t4.id is not null and src.doc_id % 2 = 0 then 4 when t3.id is not null then 5 when t4.id is not null then 6 end as tier
      from src left join t2 on t2.id = src.id left join t3 on t3.id = src.id left join t4 on t4.id = src.id)
    select source_id, tier, case when tier is not null then doc_id end as new_doc, case tier when 2 then own when 3 then nxt when 5 then nxt when 4 then i4 when 6 then i4 end as new_idx,
      case when tier in (2, 3) then 5 when tier = 5 then p3 when tier in (4, 6) then p4 end as new_start from e"""
# The names are small letters and digits, whose Chinese order is that of their codes.
ORACLES["ranked_hits"] = f"""with {HITS} select item_id, h.doc_id, block_idx, start, cast(row_number() over (partition by item_id order by source, h.doc_id, block_idx, start) as int) as rank
    from hits h join documents d on d.doc_id = h.doc_id"""
