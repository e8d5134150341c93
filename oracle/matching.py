"""SQL for the matching queries."""

SIDE = """pur as (select 'User ' || user_id as name, event_id as row_no from events where event_type = 'purchase'),
sig as (select 'User ' || user_id as name, event_id as row_no from events where event_type = 'signup'),
cnt as (select coalesce(p.name, s.name) as name, coalesce(p.n, 0) as a, coalesce(s.n, 0) as b from (select name, count(*) as n from pur group by 1) p
  full join (select name, count(*) as n from sig group by 1) s on p.name = s.name),
rec as (select lower(name) as match_name, case when a > 0 and b = 0 then '仅场次有' when a = 0 and b > 0 then '仅账单有' when a > b then '场次多' when b > a then '账单多' else '一致' end as status,
  name, a as left_count, b as right_count, a - b as diff from cnt)"""

NOTE = ("case status when '一致' then '两边姓名人次一致。' when '仅场次有' then '账单表没有该姓名。' when '仅账单有' then '场次表没有该姓名。' "
        "when '场次多' then '场次表多 ' || abs(diff) || ' 次。' else '账单表多 ' || abs(diff) || ' 次。' end")

STAYS = """bills as (select event_id as bill_idx, user_id::varchar as name, cast(ts as date) as day from events where event_type = 'purchase' and value > 1),
checkins as (select event_id as checkin_idx, user_id::varchar as name, cast(ts as date) as day from events where event_type = 'signup')"""


def nearest(tolerance):
    return f"""{STAYS},
best as (select bill_idx, b.name, b.day, c.checkin_idx, abs(b.day - c.day) as day_diff, row_number() over (partition by bill_idx order by abs(b.day - c.day), c.checkin_idx) as k
  from bills b join checkins c on c.name = b.name and abs(b.day - c.day) <= {tolerance}),
hit as (select * from best where k = 1),
matched as (select b.bill_idx, b.name, b.day, checkin_idx, day_diff, case when checkin_idx is null then 'unmatched'
  when row_number() over (partition by checkin_idx order by b.bill_idx) = 1 then 'matched' else 'duplicate' end as status from bills b left join hit using (bill_idx))"""


ROSTER = """roster as (select name, min(p_partkey) as no from (select p_partkey, unnest(string_split(p_name, ' ')) as name from part) group by 1),
hit as (select doc_id, lang, name, no, instr(text, name) as position from documents, roster where contains(text, name))"""

TECHS = "['飞行教员A','飞行教员B','飞行教员C','A类机长','B类机长','C类机长','D类机长','Z类机长','划转机长','A1类副驾驶','A2类副驾驶','B类副驾驶','C类副驾驶','D类副驾驶','划转副驾驶','签派员']"
ORIGIN_KEYS = ["总队777", "777返聘", "总队737", "总队320", "总队909", "湖南分公司", "湖北分公司", "新疆分公司", "新疆分公司（借）", "河南分公司", "西安分公司", "重庆航空",
               "汕头分公司", "珠海分公司", "广西分公司", "海南分公司", "上海分公司（借）", "外部单位", "", "总队999"]
ORIGIN_SHOWN = ["飞行/总队 777", "飞行/总队 777", "飞行/总队 737", "飞行/总队 320", "飞行/总队 909", "湖南", "湖北", "新疆", "新疆", "河南", "西安", "重庆", "汕头", "珠海", "广西", "海南", "上海",
                "其他", "其他", "其他"]

CREW = f"""p as (select l_orderkey, l_partkey, ({TECHS})[l_suppkey % 16 + 1] as label, {ORIGIN_KEYS}[l_partkey % 20 + 1] as origin, {ORIGIN_SHOWN}[l_partkey % 20 + 1] as unit,
    l_quantity > 45 as inspector, l_quantity < 5 as manager, l_returnflag = 'R' as rama, l_linestatus = 'O' as reuo, l_discount > 0.045 as rwas,
    l_tax > 0.035 as eama, l_quantity > 25 as eeuo, l_extendedprice > 50000 as ewas from lineitem),
q as (select *, label like '飞行教员%' as teacher, label like '_类机长' as captain, label in ('划转机长') as tc, label like '%类副驾驶' as fo, label = '划转副驾驶' as tf,
    origin like '总队%' or origin = '777返聘' as home from p),
f as (select *, teacher or captain or tc or fo or tf as crew, teacher or captain as cb, teacher or captain or tc as ca, fo or tf as fa,
    (teacher or label in ('A类机长', 'B类机长', 'C类机长')) and not rama and not reuo and not rwas as line from q)"""


def _items():
    rows = []

    def add(section, item, test, base, keep_zero=True):
        rows.append((section, item, test, base, keep_zero))

    add("飞行管理人员占比", "管理人员", "crew and manager", "crew")
    add("飞行管理人员占比", "非管理人员", "crew and not manager", "crew")
    for item, test in (("教员", "teacher"), ("机长", "(captain or tc)"), ("副驾驶", "fa")):
        add("教员、机长、副驾驶占比", item, test, "crew")
    s = "机长含以上各级别占比"
    add(s, "检查员", "ca and inspector", "ca")
    known = []
    for item, label in [("C类教员", "飞行教员C"), ("B类教员", "飞行教员B"), ("A类教员", "飞行教员A"), ("D类机长", "D类机长"), ("C类机长", "C类机长"), ("B类机长", "B类机长"), ("Z类机长", "Z类机长"), ("在训机长", "划转机长")]:
        add(s, item, f"ca and label = '{label}'", "ca")
        known.append(label)
    add(s, "其他", f"ca and label not in ({', '.join(repr(k) for k in known)})", "ca", False)

    def combos(section, base, names, singles, none):
        for bits in range(7, -1, -1):
            on = [i for i in range(3) if bits & (4 >> i)]
            item = none if not on else singles[on[0]] if len(on) == 1 else "+".join(("美", "欧", "西亚")[i] for i in on)
            if item:
                add(section, item, base + "".join(f" and {'' if i in on else 'not '}{n}" for i, n in enumerate(names)), base)

    combos("机长航线资格占比", "cb", ("rama", "reuo", "rwas"), ("仅北美带队", "仅欧洲带队", "仅西亚带队"), None)
    add("机长航线资格占比", "航线机长", "cb and line", "cb")
    add("机长航线资格占比", "左座带飞", "cb and label = 'Z类机长'", "cb")
    add("机长航线资格占比", "其他", "cb and not (rama or reuo or rwas or line or label = 'Z类机长')", "cb")
    radio = ("单美洲报务", "单欧洲报务", "单西亚报务")
    combos("机长报务占比", "cb", ("eama", "eeuo", "ewas"), radio, "无报务")
    for x in "DCB":
        add("副驾驶级别占比", f"{x}类副驾驶", f"label = '{x}类副驾驶'", "fa")
    add("副驾驶级别占比", "A类副驾驶", "label in ('A1类副驾驶', 'A2类副驾驶')", "fa")
    add("副驾驶级别占比", "转机型副驾驶", "tf", "fa")
    combos("副驾驶报务占比", "fo", ("eama", "eeuo", "ewas"), radio, "无报务")
    for who, base in (("机长", "ca"), ("副驾驶", "fa")):
        add("人员居住情况", f"{who}本地居住", f"{base} and home", base)
        add("人员居住情况", f"{who}异地居住", f"{base} and not home", base)
    return rows


PCT = "case when base = 0 then '0%' else cast(floor(100.0 * people / base + 0.5) as int) || '%' end as percent"


def structure_sql():
    parts = ["select '总人数及空地人员占比' as section, '总人数' as item, count_if(teacher or captain or fo) + 29 as people, count_if(teacher or captain or fo) + 29 as base, true as keep from f",
             "select '总人数及空地人员占比', '空勤人员（已注册人员）', count_if(teacher or captain or fo), count_if(teacher or captain or fo) + 29, true from f",
             "select '总人数及空地人员占比', '地面人员', 29, count_if(teacher or captain or fo) + 29, true from f"]
    parts += [f"select '{s}', '{i}', count_if({t}), count_if({b}), {str(k).lower()} from f" for s, i, t, b, k in _items()]
    return f"with {CREW}, r as ({' union all '.join(parts)}) select section, item, people, base, {PCT} from r where keep or people > 0"


REQ = """req as (select o_orderkey as sequence, lpad(o_custkey::varchar, 6, '0') as employee_id, 'Customer#' || lpad(o_custkey::varchar, 9, '0') as name, substr(o_orderpriority, 3, 3) as leave_type,
    lower(o_orderpriority) as leave_name, strftime(o_orderdate, '%Y-%m-%d') as start_date, o_orderstatus as batch, o_custkey, o_orderpriority from orders)"""

FIRST = f"""{REQ}, best as (select employee_id, name, leave_type, leave_name, start_date, min(sequence) as result_row from req where batch <> 'O' group by all)"""

FORM = """form as (select *, event_id + 2 as row_no, case when value < 1 then '' when value < 2 then 'bad' else strftime(ts, '%Y年%m月%d日') end as dd,
    case when value > 20 then '表_' || user_id else '表单_' || lpad((event_id + 1)::varchar, greatest(3, length((event_id + 1)::varchar))::int, '0') end as title,
    case when event_type = 'view' then '是' else '否' end as b, (user_id % 10)::varchar as u from events),
checked as (select *, list_filter([case when value < 1 then '日期不能为空' end, case when value >= 1 and value < 2 then '日期不是有效日期' end, case when event_type = 'error' then '是否只能填写 是/否' end,
    case when event_type not in ('click', 'view', 'error') then '单选选项无效：' || event_type end, case when u not in ('7', '8') then '多选包含无效选项：' || u end], lambda x: x is not null) as errors from form)"""

BOOK = """rows_ as (select c_mktsegment as workbook, '表' || c_nationkey as sheet, c_custkey, c_name, c_acctbal from customer), sheets as (select distinct workbook, sheet from rows_)"""

ORACLES = {
    "reconcile_counts": f"with {SIDE} select *, {NOTE} as note from rec",
    "reconcile_summary": f"""with {SIDE} select cast(sum(left_count) as bigint) as left_total, count_if(left_count > 0) as left_names, cast(sum(right_count) as bigint) as right_total, count_if(right_count > 0) as right_names,
        count(*) as compared, count_if(status = '一致') as matched, count_if(status <> '一致') as mismatched, count_if(status = '一致') as status_0, count_if(status = '场次多') as status_1,
        count_if(status = '账单多') as status_2, count_if(status = '仅场次有') as status_3, count_if(status = '仅账单有') as status_4 from rec""",
    "reconcile_differences": f"with {SIDE} select match_name, status, diff from rec where status <> '一致'",
    "reconcile_references": f"""with {SIDE}, r as (select 'left' as side, 'purchase' as sheet, * from pur union all select 'right', 'signup', * from sig)
        select lower(name) as match_name, side, 0 as part, string_agg(sheet || '!第' || row_no || '行/学员', '；' order by row_no) as refs, min(name) as names from r group by 1, 2""",
    "split_names_reconcile": f"""with l as (select unnest(string_split(p_name, ' ')) as n from part union all select lower(p_type) from part),
        r as (select string_split(p_name, ' ')[2] as n from part union all select lower(p_type) from part where p_partkey % 2 = 0),
        c as (select coalesce(a.n, b.n) as match_name, coalesce(x, 0) as left_count, coalesce(y, 0) as right_count from (select n, count(*) as x from l group by 1) a full join (select n, count(*) as y from r group by 1) b on a.n = b.n),
        s as (select *, left_count - right_count as diff, case when left_count > 0 and right_count = 0 then '仅场次有' when left_count = 0 and right_count > 0 then '仅账单有' when left_count > right_count then '场次多'
          when right_count > left_count then '账单多' else '一致' end as status from c)
        select match_name, status, left_count, right_count, diff, {NOTE} as note from s""",
    "key_union": "select distinct 'user ' || user_id as match_name from events where event_type in ('purchase', 'signup')",
    "nearest_date_match": f"with {nearest(2)} select * from matched",
    "nearest_date_wide": f"with {nearest(730)} select * from matched",
    "skipped_bills": "select event_id as bill_idx, user_id::varchar as name from events where event_type = 'purchase' and not (value > 1)",
    "proof_columns": f"with {nearest(2)} select bill_idx, status, 'u' || checkin_idx || '-3' as link1, 'u' || checkin_idx || '-7' as link2 from matched",
    "proof_width": "select 1 as columns",
    "mentions_crosstab": f"with {ROSTER} select name, lang, count(*) as mentions from hit group by 1, 2",
    "mentions_wide": f"""with {ROSTER} select name, min(no) as roster_no, nullif(count_if(lang = 'de'), 0) as de, nullif(count_if(lang = 'en'), 0) as en, nullif(count_if(lang = 'es'), 0) as es,
        nullif(count_if(lang = 'fr'), 0) as fr from hit group by 1""",
    "mentions_lookup": f"with {ROSTER} select doc_id, name, position from hit",
    "first_positions": f"with {ROSTER} select doc_id, string_agg(name, ' ' order by position, no, name) as names from hit group by 1",
    "unmatched_cells": f"with {ROSTER} select doc_id, substr(regexp_replace(text, '^\\s+', ''), 1, 50) as note from documents where doc_id not in (select doc_id from hit) and trim(text) <> ''",
    "route_order": "select o_orderpriority as route, min(o_orderkey) as first_row from orders group by 1",
    "annotate_list": """with cat as (select * from (values ('重点关注', 1, '重点'), ('一般关注', 2, '一般'), ('预防性关注', 3, '预防'), ('三新人员（不上会）', 4, '三新'), ('长期关注', 5, '长期')) t(category, p, l)),
        foc as (select c_custkey, c_nationkey % 5 + 1 as p from customer where c_acctbal > 3000 union select c_custkey, 5 from customer where c_mktsegment = 'BUILDING'),
        per as (select c_custkey, string_agg('[' || l || ']', '' order by p) as labels, arg_min(category, p) as top from foc join cat using (p) group by 1)
        select o_orderkey as row_no, 'Customer#' || lpad(o_custkey::varchar, 9, '0') || coalesce(labels, '') as annotated, top as top_category from orders left join per on c_custkey = o_custkey""",
    "annotation_totals": """with cat as (select * from (values ('重点关注', 1), ('一般关注', 2), ('预防性关注', 3), ('三新人员（不上会）', 4), ('长期关注', 5)) t(category, p)),
        foc as (select c_custkey, c_nationkey % 5 + 1 as p from customer where c_acctbal > 3000 union select c_custkey, 5 from customer where c_mktsegment = 'BUILDING')
        select 'category' as scope, category as label, count(*) as n from orders join foc on c_custkey = o_custkey join cat using (p) group by 2
        union all select 'sheet', o_orderpriority, count(*) from orders where o_custkey in (select c_custkey from foc) group by 2""",
    "structure_report": structure_sql(),
    "origin_summary": f"""with {CREW}, t as (select count(*) as base from f where crew), u as (select unnest(list_distinct({ORIGIN_SHOWN})) as item),
        r as (select item, count(l_orderkey) as people, any_value(base) as base from u left join (select * from f where crew) c on unit = item, t group by 1)
        select item, people, base, {PCT} from r where item <> '其他' or people > 0""",
    "unrecognized_values": f"with {CREW} select distinct 'tech' as kind, '技术信息：' || label as value from f where not crew union select distinct 'origin', origin from f where crew and origin <> '' and unit = '其他'",
    "residual_people": f"""with {CREW} select '机长含以上各级别占比' as section, l_orderkey || ' P' || l_partkey as person from f where ca and label = 'A类机长'
        union all select '机长航线资格占比', l_orderkey || ' P' || l_partkey from f where cb and not (rama or reuo or rwas or line or label = 'Z类机长')""",
    "dedupe_first": "select doc_id, doc_id = min(doc_id) over (partition by md5(text)) as is_first from documents",
    "request_intake": """with r as (select o_orderkey as row_no, case when o_orderstatus = 'P' then lpad(o_custkey::varchar, 6, '1') when o_totalprice > 250000 then (o_custkey + 200000) || '.0' else 'x' || o_custkey end as shown_id from orders),
        v as (select *, case when shown_id like 'x%' then '' else replace(shown_id, '.0', '') end as employee_id from r)
        select row_no, employee_id, '张 三' as name, shown_id, case when employee_id = '' then '员工号不是 6 位数字' when row_number() over (partition by employee_id order by row_no) > 1 then '重复员工号，已跳过' end as reason from v""",
    "row_alignment": """select o_orderkey, case when o_orderstatus = 'F' and (o_orderpriority = '5-LOW' or length((o_orderkey % 20000)::varchar) > 4) then (o_orderkey % 20000) || '|' || o_custkey || '|' || o_orderstatus
        else o_custkey || '|' || o_orderstatus end as cells from orders""",
    "first_result_matches": f"with {FIRST} select r.sequence, result_row from req r left join best using (employee_id, name, leave_type, leave_name, start_date)",
    "paired_results": f"""with {REQ}, k as (select *, row_number() over (partition by employee_id, leave_type, start_date order by sequence) as k from req),
        a as (select employee_id, leave_type, start_date, sequence + 1 as result_row, row_number() over (partition by employee_id, leave_type, start_date order by sequence) as k from req where batch = 'P')
        select k.sequence, result_row from k left join a using (employee_id, leave_type, start_date, k)""",
    "attempt_notes": f"""with {REQ}, t as (select sequence, sequence % 1000 as attempted, case batch when 'F' then 'remark' when 'P' then 'error ' || leave_name else batch end as note from req)
        select attempted as sequence, arg_max(note, sequence) as note from t group by 1""",
    "request_outcomes": f"""with {FIRST}, clash as (select distinct employee_id, name, leave_type, start_date from req where batch = 'P' and sequence % 2 = 0),
        j as (select r.sequence, r.batch, b.result_row is not null as found, c.employee_id is not null as conflict from req r left join best b using (employee_id, name, leave_type, leave_name, start_date)
          left join clash c using (employee_id, name, leave_type, start_date))
        select sequence, case batch when 'P' then (case when conflict then '冲突' else '异常' end) when 'F' then (case when found then '成功' else '异常' end) else '失败' end as status from j""",
    "audit_flags": f"""with {REQ}, s as (select *, case when batch = 'F' then '别人' else name end as r_name, case when batch = 'P' then '2030-01-01' else '' end as r_end,
          case when batch <> 'O' then '' when sequence % 2 = 0 then 'ZZZ' else leave_type || '-' || substr(leave_name, 3) end as r_type from req),
        t as (select *, r_name = name as name_ok, r_end = '' or r_end = start_date as date_ok,
          r_type = '' or split_part(r_type, '-', 1) = leave_type as type_ok from s)
        select sequence, '是' as id_matched, case when name_ok then '是' else '否' end as name_matched, case when date_ok then '是' else '否' end as date_matched, case when type_ok then '是' else '否' end as type_matched,
          case when not name_ok then '结果姓名不匹配: 输入' || name || ', 页面' || r_name when not date_ok then '结果结束日期不匹配: 输入' || start_date || ', 页面' || r_end
            when not type_ok then '结果锁班类型不匹配: 输入' || leave_name || ', 页面' || r_type else '' end as problem, case when name_ok then '是' else '否' end as page_name from t""",
    "employee_rows": f"""with {REQ}, t as (select sequence as row_no, case when batch = 'F' then employee_id else name end || '/' || start_date as row_text from req where batch <> 'O'),
        k as (select distinct employee_id, name from req), m as (select employee_id, min(row_no) as matched_row from k, t where contains(row_text, employee_id) or contains(row_text, name) group by 1)
        select sequence, matched_row from req left join m using (employee_id)""",
    "whitelist_join": "select o_orderkey as sequence, lpad(o_custkey::varchar, 6, '0') as employee_id from orders where o_custkey in (select c_custkey from customer where c_acctbal > 5000)",
    "merged_details": "select 'supplier' as kind, s_suppkey as key, s_acctbal as balance, null as segment from supplier union all select 'customer', c_custkey, null, c_mktsegment from customer",
    "loop_fields": """with f as (select n_name as name, case when n_regionkey = 2 then 'shared' else n_name end as sheet from nation where n_nationkey % 3 = 0),
        c as (select case when c_custkey % 5 = 0 then 'shared' else n_name end as sheet, c_name as sub_name from customer join nation on n_nationkey = c_nationkey)
        select name as loop, sub_name from f join c using (sheet)""",
    "non_blank_rows": "select o_orderkey from orders where o_orderstatus <> 'F' or o_totalprice > 100000",
    "reject_reasons": """select o_orderkey as line_no, case when o_orderkey % 5 = 0 then '未识别员工号' when o_orderkey % 3 = 0 then '未识别请假类型' when o_orderstatus = 'P' then '未识别日期' end as reason from orders""",
    "header_rows": f"with {BOOK} select workbook, sheet, 3 as header_row, 3 as loose_row from sheets",
    "bound_rows": f"with {BOOK} select workbook, sheet, c_custkey + 4 as row_no, c_custkey::varchar as employee_id, c_name as name, case when c_acctbal < 0 then '' else '项目' end as project from rows_",
    "missing_headers": f"with {BOOK} select workbook, sheet, '备注' as header, 2 as col_no, 9 as fallback_col from sheets",
    "sheet_roles": """with s as (select c_mktsegment as workbook, '表 ' || (c_nationkey % 6) as sheet, min(c_custkey) as no from customer group by 1, 2),
        r as (select workbook, case when sheet = '表 1' then '甲' when sheet in ('表 2', '表 3') then '乙' end as role, sheet, no from s),
        b as (select workbook, role, arg_min(sheet, no) as sheet from r where role is not null group by 1, 2)
        select * from b union all select workbook, '', sheet from s where (workbook, sheet) not in (select (workbook, sheet) from b)""",
    "batch_validation": f"""with {FORM} select row_no, title, case when dd = 'bad' then '' else dd end as day, b, case when b = '是' then '☑' else '□' end as "bPass", case when b = '是' then '□' else '☑' end as "bFail", event_type as r,
        case when event_type = 'click' then '☑' else '□' end as r_click, u || '、7' as m, case when u = '8' then '☑' else '□' end as m_8, '☑' as m_7, '无' as t, array_to_string(errors, '|') as errors from checked""",
    "batch_gate": f"with {FORM} select count(*) as total, count_if(len(errors) > 0) as failed, count_if(len(errors) > 0) = 0 as open from checked",
    "unique_file_names": f"""with {FORM}, k as (select *, row_number() over (partition by title order by row_no) as k from checked)
        select row_no, title || case when k > 1 then '_' || k else '' end || '.docx' as file_name, case when len(errors) > 0 then '失败' else '成功' end as state from k""",
    "field_configs": """select n_name as name, case when n_nationkey % 2 = 0 then lower(n_name) else n_name end as label,
        (['text','text','textarea','textarea','date','boolean','boolean','radio','checkbox','loop','loop','loop'])[n_nationkey % 12 + 1] as type, n_regionkey = 1 as required,
        case when n_regionkey = 0 then 3 else n_regionkey end as rows from nation""",
    "evidence_import": """with b as (select item_id, case when item_id % 7 <> 0 then item_id + 1 end as seq from benchmark),
        p as (select *, coalesce(seq, (select count(seq) from b) + row_number() over (partition by seq is null order by item_id)) as position from b),
        m as (select n_nationkey % 10 + 1 as s, string_agg(n_name, ',' order by n_nationkey) as v from nation group by 1),
        a as (select n_regionkey + 1 as s, string_agg(n_name, ',' order by n_nationkey) as v from nation where n_nationkey > 5 group by 1)
        select position, 'C' || item_id as code, item_id % 3 <> 0 as enabled, coalesce(m.v, '') as manual, coalesce(a.v, '') as audit from p left join m on m.s = position left join a on a.s = position""",
}

# An employee's rows of one class and day are taken in order: a failed attempt for good removes its own request, one that may
# be tried again does nothing, any other row takes the first waiting request of its type and day if its text holds the end day.
# Recursion walks the rows of each employee and keeps the waiting list.
ORACLES["partial_pairs"] = f"""with recursive {REQ}, r as (select *, batch = 'P' and (sequence % 7 = 0 or sequence % 11 = 0) as failed, sequence % 7 <> 0 as retryable,
      row_number() over (partition by employee_id, batch order by sequence) as n from req where batch <> 'O'),
    w as (select employee_id, batch, list({{'s': sequence, 't': leave_name, 'd': start_date}} order by sequence) as waiting from req group by 1, 2),
    f(employee_id, batch, n, waiting, sequence, result_row, state) as (
      select employee_id, batch, 0::bigint, waiting, null::bigint, null::bigint, null::varchar from w
      union all
      select f.employee_id, f.batch, r.n, list_filter(f.waiting, lambda x: x.s is distinct from
          (case when r.failed then (case when not r.retryable then r.sequence end) when r.sequence % 2 = 0 then list_filter(f.waiting, lambda y: y.t = r.leave_name and y.d = r.start_date)[1].s end)),
        case when r.failed then (case when not r.retryable then r.sequence end) when r.sequence % 2 = 0 then list_filter(f.waiting, lambda y: y.t = r.leave_name and y.d = r.start_date)[1].s end,
        r.sequence, case when r.failed then 'failed' else 'matched' end
      from f join r on r.employee_id = f.employee_id and r.batch = f.batch and r.n = f.n + 1)
    select sequence, result_row, state from f where sequence is not null"""
ORACLES["request_summary"] = f"""with o as ({ORACLES["request_outcomes"]}), i as ({ORACLES["request_intake"]})
    select count(*) as valid, count_if(status = '成功') as succeeded, count_if(status <> '成功') as failed, (select count(reason) from i) as input_errors from o"""
ORACLES["written_report"] = """select '优先级' as section, o_orderpriority as item, count(*) as amount from orders group by 2 union all select '状态', o_orderstatus, count(*) from orders group by 2
    union all select '客户', o_custkey::varchar, count(*) from orders group by 2"""
ORACLES["failed_log"] = f"select row_no, shown_id, reason from ({ORACLES['request_intake']}) where reason is not null"
ORACLES["package_check"] = """with f as (select source || '-' || (doc_id // 10000) as source, string_agg(doc_id || ' ' || md5(text), chr(10) order by doc_id) || chr(10) as body from documents group by 1),
    d as (select source, strlen(body) as size, sha256(body) as sha from f),
    m as (select source as path, if(source = 'src3-0', size + 1, size) as size, if(source = 'src5-0', sha256(source), sha) as sha256 from d union all select 'none', size, sha from d where source = 'src1-0')
    select path, m.size, sha256, case when d.source is null then '项目包缺少文件' when d.size <> m.size or d.sha <> m.sha256 then '项目文件校验失败' end as reason from m left join d on d.source = m.path"""
