"""SQL for the training queries."""

TODAY, STAGE_END, YEAR, RENEWAL_DAY = "date '2002-06-10'", "date '2002-07-31'", 1998, "date '1999-06-01'"

PROJECT = ("case o_orderpriority when '1-URGENT' then '应急训练' when '2-HIGH' then '危险品' when '3-MEDIUM' then '航空安保' "
           "when '4-NOT SPECIFIED' then 'TSA' when '5-LOW' then '英语能力' end")
NAME = "'Customer#' || lpad(cast(o_custkey as varchar), 9, '0')"

RULES = """rules as (select * from (values
  ('应急训练', 'base', 24, 1, 0, true), ('危险品', 'window', 24, 0, -1, false), ('航空安保', 'latest', 24, 0, 0, true),
  ('TSA', 'latest', 12, 0, 0, true), ('疲劳管理', 'latest', 24, 0, 0, true), ('飞行作风', 'latest', 24, 0, 0, true),
  ('英语能力', 'window', 36, 0, 0, false), ('汉语能力', 'window', 72, 0, 0, false)) t(project, kind, months, flex, off, mend))"""

TRAIN = f"""train as (select {PROJECT} as project, case when o_totalprice > 480000 then '' else cast(o_custkey as varchar) end as employee_id,
    {NAME} as name, cast(o_orderdate as date) as start_date, cast(o_orderdate as date) + cast(o_orderkey % 3 as int) as end_date,
    o_orderstatus = 'F' as recorded, o_orderstatus in ('F', 'P') as flagged, o_totalprice < 20000 as cancelled, o_orderkey as row_no,
    o_custkey, '教员' || (o_custkey % 7) as instructor, case when o_orderstatus in ('F', 'P') then 'Y' else '' end as machine_flag from orders)"""


def months(date, n):
    return f"cast({date} + to_months(cast({n} as int)) as date)"


def first(date):
    return f"cast(date_trunc('month', {date}) as date)"


def valid(date):
    return f"(case when mend then last_day({months(date, 'months')}) else {months(date, 'months')} end)"


WS = lambda old: f"(case kind when 'base' then {months(first(months(old, -1)), '-flex')} when 'window' then {months(old, -3)} end)"
WE = lambda old: f"(case kind when 'base' then last_day({months(first(months(old, -1)), 'flex')}) when 'window' then {old} + off end)"
DUE = lambda old: f"coalesce({WE(old)}, {old})"
INSIDE = lambda d, old: f"coalesce({d} between {WS(old)} and {WE(old)}, false)"
NEW = lambda d, old: (f"(case when {INSIDE(d, old)} then {valid(old)} when kind = 'base' then last_day({months(first(d), 'months + 1')}) else {valid(d)} end)")
JUDGE = lambda d, old: (f"(case when {old} is null then '首次无旧值' when kind = 'latest' then (case when {d} > {old} then '超期' else '最新日期重算' end) "
                        f"when {INSIDE(d, old)} then '命中窗口' when {d} > {WE(old)} then '超期' else '提前窗口外' end)")
DECIDE = lambda old, new, today: (f"(case when {new} < {today} then '更新无效' when {new} < {old} then '有效期回退' when {new} = {old} then '不变' else '已更新' end)")
COVERS = lambda d, old: f"coalesce({d} <= {DUE(old)} and {NEW(d, old)} > {old}, false)"


def need(start, end, old):
    due = DUE(old)
    return (f"(case when {due} < {start} then '已过期' when {due} between {start} and {end} then '必须排' "
            f"when case when kind = 'latest' then {start} <= {due} and {first(months(due, -2))} <= {end} else {start} <= {WE(old)} and {WS(old)} <= {end} end then '推荐排' else '正常' end)")


BOARD = f"""{RULES},
ship as (select {PROJECT} as project, cast(o_custkey as varchar) as t_id, cast(l_shipdate as date) as day, l_linestatus = 'F' as recorded,
    l_discount > 0.095 as cancelled, l_orderkey * 10 + l_linenumber as row_no from lineitem join orders on l_orderkey = o_orderkey),
cells as (select {PROJECT} as project, o_custkey as c, cast(max(o_orderdate) as date) as d from orders group by all),
ppl as (select cells.project, cast(c as varchar) as employee_id, c_name as name, c as person_row, c_acctbal < 0 as bad_cell, {months('d', 24)} as old
    from cells join customer on c = c_custkey where not (c_acctbal > 9500) and not (c_nationkey = 7 and cells.project = 'TSA')),
good as (select * from ppl join rules using (project) where not bad_cell),
hits as (select g.project, person_row, s.day, s.row_no, not s.cancelled as active, s.recorded and s.cancelled as abnormal, {COVERS('s.day', 'g.old')} as covers
    from good g join ship s on s.project = g.project and s.t_id = g.employee_id),
facts as (select project, person_row, min((day, row_no)) filter (abnormal) as bad, min((day, row_no)) filter (active) as plan,
    min((day, row_no)) filter (active and covers) as cover from hits group by all),
needs as (select g.*, bad, plan, cover, {need(TODAY, STAGE_END, 'old')} as need, {DUE('old')} as due from good g left join facts using (project, person_row)),
board as (
  select case when bad is not null then '异常' when cover is not null then '正常' when plan is not null and need = '已过期' then '已过期已排补训'
      when plan is not null and need in ('必须排', '推荐排') then '已排未覆盖' else need end as status, project, employee_id, name,
    cast(old as varchar) as expiry, strftime(due, '%Y-%m') as due_month, cast(due as varchar) as due_date,
    coalesce(cast(cover[1] as varchar), cast(plan[1] as varchar), '') as scheduled_date,
    case when bad is not null then project || ' 第' || bad[2] || '行' when cover is not null then project || ' 第' || cover[2] || '行'
      when plan is not null and need in ('已过期', '必须排', '推荐排') then project || ' 第' || plan[2] || '行' else '人员信息表 第' || person_row || '行' end as source
  from needs
  union all select '异常', project, employee_id, name, '待定', '', '', '', '人员信息表 第' || person_row || '行' from ppl where bad_cell)"""

SEEN = "status <> '正常'"
BUCKETS = ", ".join(f"count_if(status = '{s}') as {n}" for s, n in (
    ("已过期", "expired"), ("已过期已排补训", "expired_planned"), ("必须排", "must"), ("已排未覆盖", "uncovered"), ("推荐排", "recommended"), ("异常", "abnormal")))
ZEROS = ", ".join(f"coalesce({n}, 0) as {n}" for n in ("expired", "expired_planned", "must", "uncovered", "recommended", "abnormal"))

ATTEND = f"""{TRAIN},
recs as (select *, coalesce(nullif(employee_id, ''), name) as person from train where project = 'TSA' and not cancelled and year(start_date) = {YEAR}),
keyed as (select key, min(start_date) as day from (select employee_id as key, start_date from recs where employee_id <> '' union all select name, start_date from recs) group by 1),
need as (select cast(c_custkey as varchar) as employee_id, c_name as name, c_custkey as row_no,
    (['飞行教员A','飞行教员B','飞行教员C','A类机长','B类机长','C类机长','D类机长','Z类机长','划转机长','A1类副驾驶','A2类副驾驶','B类副驾驶','C类副驾驶','D类副驾驶','划转副驾驶','签派员'])[c_nationkey % 16 + 1] as tech
    from customer where c_nationkey <> 3),
att as (select n.*, least(a.day, b.day) as first_day from need n left join keyed a on a.key = n.employee_id left join keyed b on b.key = n.name)"""

RENEW = f"""{RULES}, {TRAIN},
cells as (select distinct {PROJECT} as project, o_custkey as c from orders),
old as (select cells.project, c, case when c_acctbal < 0 or c_acctbal > 9500 then null else date '1997-01-01' + cast(c % 700 as int) end as old from cells join customer on c = c_custkey),
flag as (select *, row_number() over (partition by o_custkey, project order by start_date, row_no) as k from train where flagged and not cancelled)"""

FOLD = f"""with recursive {RENEW},
step as (
  select f.o_custkey, f.project, f.k, f.row_no, o.old as was, {NEW('f.start_date', 'o.old')} as new, {JUDGE('f.start_date', 'o.old')} as judgement,
    {DECIDE('o.old', NEW('f.start_date', 'o.old'), RENEWAL_DAY)} as result
  from flag f join old o on o.c = f.o_custkey and o.project = f.project join rules r on r.project = f.project where k = 1
  union all
  select f.o_custkey, f.project, f.k, f.row_no, s.cur, {NEW('f.start_date', 's.cur')}, {JUDGE('f.start_date', 's.cur')}, {DECIDE('s.cur', NEW('f.start_date', 's.cur'), RENEWAL_DAY)}
  from (select *, case when result = '已更新' then new else was end as cur from step) s
  join flag f on f.o_custkey = s.o_custkey and f.project = s.project and f.k = s.k + 1 join rules r on r.project = f.project),
run as (
  select row_no, project, o_custkey as person_row, was as old_expiry, new as new_expiry, judgement, result, cast(null as varchar) as skip_status from step
  union all select row_no, project, o_custkey, null, null, null, null, '记录异常' from train where flagged and cancelled)"""

ORACLES = {
    "record_policies": f"""with {TRAIN}
        select row_no, not cancelled as active, recorded and cancelled as abnormal, case when recorded and cancelled then '已录入但备注取消' when cancelled then '已取消' when recorded then '已录入' else '未录入' end as record_status,
          case when recorded and cancelled then '培训信息是否录入为“是”，但备注包含“取消”，数据矛盾，需人工确认。' when cancelled then '备注包含“取消”，这条计划记录不参与覆盖判断。' else '' end as record_reason,
          start_date as train_date, flagged and not cancelled as renew_active, flagged and cancelled as renew_abnormal,
          case when flagged and cancelled then '机器看Y但备注取消' when cancelled then '已取消' when flagged then '机器看Y' else '机器看非Y' end as renew_status,
          recorded as in_recorded, not recorded and not cancelled as in_pending, flagged as in_update from train""",
    "rule_outcomes": f"""with {RULES},
        o as (select o_orderkey, {PROJECT} as project, cast(o_orderdate as date) as day,
          case when o_totalprice > 30000 then cast(o_orderdate as date) + (cast(trunc(fmod(o_totalprice, 400)) as int) - 200) end as old from orders)
        select o_orderkey, project, {WS('old')} as win_start, {WE('old')} as win_end, {DUE('old')} as due, {NEW('day', 'old')} as new_expiry,
          {JUDGE('day', 'old')} as judgement, {DECIDE('old', NEW('day', 'old'), RENEWAL_DAY)} as decision, {COVERS('day', 'old')} as covers from o join rules using (project)""",
    "stage_states": f"""with {RULES}, p as (select date '1998-03-01' as s, date '1998-04-30' as e),
        o as (select o_orderkey, {PROJECT} as project, cast(o_orderdate as date) as old from orders),
        t as (select *, case when {DUE('old')} < s then '已过期' when s <= {WE('old')} and {WS('old')} <= e then '命中窗口' when kind = 'latest' and old between s and e then '本阶段到期'
            when kind = 'latest' then '阶段外未到期' else '有效未到窗口' end as stage from o join rules using (project), p),
        u as (select *, case when {DUE('old')} < s or stage = '已过期' then 50 when kind = 'window' and {DUE('old')} - e <= 30 then 40 when kind = 'window' and {DUE('old')} - e <= 60 then 30
            when kind = 'window' and {DUE('old')} - e <= 90 then 20 when stage = '本阶段到期' then 15 when stage = '命中窗口' then 10 else 0 end as urgency from t)
        select o_orderkey, case when s > {DUE('old')} then '已过期' when {INSIDE('s', 'old')} then '命中窗口' else '有效未到窗口' end as point, stage, urgency,
          case urgency when 50 then '已过期' when 40 then '30天内到期' when 30 then '60天内到期' when 20 then '90天内到期' when 15 then '本阶段到期' when 10 then '命中窗口' else '' end as urgency_label,
          {need('s', 'e', 'old')} as need from u""",
    "status_board": f"with {BOARD} select * from board",
    "board_filter": f"""with {BOARD} select * from board where {SEEN} and project in ('危险品', 'TSA', '英语能力') and
        (contains(employee_id, '1') or contains(name, '1') or contains(expiry, '1') or contains(due_month, '1') or contains(scheduled_date, '1') or contains(source, '1'))""",
    "status_cards": f"""with {BOARD} select s.status, count(board.status) as n from (values ('已过期'), ('已过期已排补训'), ('必须排'), ('已排未覆盖'), ('推荐排'), ('异常')) s(status)
        left join board on board.status = s.status group by 1""",
    "project_matrix": f"""with {BOARD}, m as (select project, {BUCKETS}, count(*) as total from board where {SEEN} group by 1)
        select project, {ZEROS}, coalesce(total, 0) as total from rules left join m using (project)""",
    "board_order": f"""with {BOARD} select project, employee_id, status, cast(coalesce(list_position(['已过期', '已过期已排补训', '必须排', '已排未覆盖', '推荐排', '异常', '正常'], status) - 1, 99) as int) as rank from board""",
    "matrix_order": f"""with {BOARD}, m as (select project, {BUCKETS}, count(*) as total from board where {SEEN} group by 1),
        z as (select project, {ZEROS}, coalesce(total, 0) as total from rules left join m using (project))
        select project, cast(row_number() over (order by total desc, expired desc, expired_planned desc, must desc, uncovered desc, recommended desc, project) as int) as place from z""",
    "month_grid": f"""with {BOARD}, m as (select due_month, {BUCKETS} from board where {SEEN} group by 1)
        select d.due_month, {ZEROS} from (select '2002-' || lpad(i::varchar, 2, '0') as due_month from range(1, 13) t(i)) d left join m using (due_month)""",
    "risk_items": f"""with {BOARD}, r as (select employee_id as person, case status when '已过期' then 0 when '已过期已排补训' then 1 when '必须排' then 2 when '已排未覆盖' then 3 when '推荐排' then 4 when '异常' then 5 end as rank,
            status, project, due_date, expiry from board where {SEEN})
        select person, row_number() over (partition by person order by rank, status, project) - 1 as place, rank, status, project, due_date, expiry from r""",
    "person_risk": f"""with {BOARD} select employee_id as person, employee_id, min(name) as name, {BUCKETS}, count(*) as total,
        coalesce(min(nullif(due_date, '')), '') as nearest_due from board where {SEEN} group by employee_id""",
    "top_rows": f"""with {BOARD} select project, status, rank, total, due_date, name, employee_id from (select *, row_number() over (partition by project, status order by due_date, name, employee_id) as rank,
        count(*) over (partition by project, status) as total from board where {SEEN}) where rank <= 80""",
    "board_facets": f"""with {BOARD} select distinct 'project' as facet, project as value from board union select distinct 'status', status from board
        union select distinct 'month', due_month from board where due_month <> ''""",
    "worst_tones": f"""with {BOARD} select employee_id, (['red', 'orange', 'green'])[min(case when status in ('已过期', '必须排', '已排未覆盖', '异常') then 1 when status = '推荐排' then 2 else 3 end)] as tone from board group by 1""",
    "scheduled_distribution": f"""with {TRAIN}, s as (select * from train where not cancelled),
        d as (select 'month' as dim, strftime(start_date, '%Y-%m') as label, project from s union all select 'date', cast(start_date as varchar), project from s union all select 'project', project, project from s),
        c as (select dim, label, project, count(*) as c from d group by all)
        select dim, label, cast(sum(c) as bigint) as total, string_agg(project || ' ' || c, '；' order by c desc, project) as project_summary from c group by 1, 2""",
    "schedule_filter": f"with {TRAIN} select row_no, project, strftime(start_date, '%Y-%m') as month, start_date as train_date from train where not cancelled and project = 'TSA' and year(start_date) = {YEAR}",
    "selected_rows": f"with {BOARD} select project, employee_id, status from board where employee_id in (select cast(c_custkey as varchar) from customer where c_mktsegment = 'BUILDING')",
    "yearly_training": f"""with {TRAIN}, r as (select * from train where recorded and not cancelled and year(start_date) = {YEAR})
        select 'project' as dim, project as label, count(*) as total from r group by 2
        union all select 'month', m.label, count(r.project) from (select '{YEAR}-' || lpad(i::varchar, 2, '0') as label from range(1, 13) t(i)) m left join r on strftime(start_date, '%Y-%m') = m.label group by 2""",
    "pending_defaults": f"""with {TRAIN}, p as (select *, strftime(start_date, '%Y-%m') as month from train where not recorded and not cancelled)
        select project, month, arg_min(instructor, row_no) as instructor, arg_min(machine_flag, row_no) filter (machine_flag <> '') as machine_flag, 'month' as scope from p group by 1, 2
        union all select project, null, arg_min(instructor, row_no), arg_min(machine_flag, row_no) filter (machine_flag <> ''), 'all' from p group by 1""",
    "pending_sessions": f"""with {TRAIN} select project, strftime(start_date, '%Y-%m') as month, start_date, end_date, min(row_no) as first_row from train where not recorded and not cancelled group by 1, 2, 3, 4""",
    "common_months": f"""with {TRAIN} select strftime(start_date, '%Y-%m') as month from train where flagged and project in ('危险品', 'TSA', '英语能力') group by 1 having count(distinct project) = 3""",
    "what_if_board": f"""with {BOARD.replace(" and not (c_nationkey = 7 and cells.project = 'TSA')", '').replace('from lineitem join orders on l_orderkey = o_orderkey)', "from lineitem join orders on l_orderkey = o_orderkey union all select distinct 'TSA', cast(o_custkey as varchar), date '2002-06-20', false, false, o_custkey from orders where o_orderpriority = '4-NOT SPECIFIED')")}
        select s.status, count(board.status) as n from (values ('已过期'), ('已过期已排补训'), ('必须排'), ('已排未覆盖'), ('推荐排'), ('异常')) s(status) left join board on board.status = s.status group by 1""",
    "renewal_run": f"{FOLD} select * from run",
    "renewal_choice": FOLD.replace("from orders)", f"from orders where {PROJECT} in ('TSA', '危险品') and strftime(o_orderdate, '%Y-%m') = '1998-05')") + " select * from run",
    "written_expiry": f"""{FOLD}, w as (select person_row, project, max(new_expiry) as e from run where result = '已更新' group by 1, 2)
        select c as person_row, cells.project, coalesce(cast(e as varchar), case when c_acctbal < 0 then '待定' when c_acctbal > 9500 then '/' else cast(date '1997-01-01' + cast(c % 700 as int) as varchar) end) as raw_expiry
        from cells join customer on c_custkey = c left join w on w.person_row = c and w.project = cells.project""",
    "renewal_counts": f"""{FOLD} select count(*) as matched, count_if(result = '已更新') as updated, count_if(result = '不变') as unchanged, count_if(result = '有效期回退') as rollback,
        count_if(result = '更新无效') as invalid, count_if(skip_status is not null) as skipped from run""",
    "updated_people": f"""{FOLD}, l as (select person_row, project, max(new_expiry) as e from run where result = '已更新' group by 1, 2)
        select person_row, count(*) as changed_cells, string_agg(project || '=' || e, ';' order by project) as changes from l group by 1""",
    "resolved_people": f"""with {TRAIN},
        p as (select cast(c_custkey as varchar) as id, substr(c_name, 1, 16) as name, c_custkey as row from customer),
        t as (select row_no, employee_id as e, case when row_no % 5 = 0 then '' else substr(name, 1, 16) end as n from train),
        bn as (select name, count(*) as c, min(row) as row, arg_min(id, row) as id from p group by 1),
        j as (select t.*, bn.c as nn, bn.row as nr, bn.id as nid, pi.row as pr, pb.row as br from t left join bn on bn.name = t.n and t.n <> ''
          left join p pi on pi.id = t.e left join p pb on pb.id = t.e and pb.name = t.n),
        e as (select *, case when nn = 1 and e <> '' and nid <> e then '姓名命中，但员工号不一致（人员信息表：' || nid || '）。'
            when nn > 1 and e = '' then '人员信息表中存在重名，且项目 sheet 的更新记录缺少员工号，无法唯一定位。' when nn > 1 and br is null then '人员信息表中存在重名，员工号也无法唯一确认。'
            when nn is null and pr is null then '未在人员信息表中找到对应人员。' end as match_error from j)
        select row_no, case when match_error is not null then null when nn = 1 then nr when nn > 1 then br else pr end as person_row,
          case when match_error is not null then null when nn = 1 then '姓名' when nn > 1 then '姓名 + 员工号' else '员工号二次验证' end as matched_by, match_error from e""",
    "attendance": f"with {ATTEND} select row_no, employee_id, name, first_day is not null as attended, first_day from att",
    "participation": f"with {ATTEND} select case when first_day is null then 'missing' else 'attended' end as kind, count(*) as people from att group by 1",
    "attendance_by_month": f"with {ATTEND} select cast(m as int) as month, count(att.row_no) as people from range(0, 13) t(m) left join att on coalesce(month(first_day), 0) = m group by 1",
    "attendance_by_role": f"""with {ATTEND}, r as (select case when contains(tech, '教员') then '教员' when contains(tech, '机长') then '机长' when contains(tech, '副驾驶') then '副驾驶' else '未识别' end as role, first_day from att)
        select role, count(first_day) + count_if(first_day is null) as required, count(first_day) as attended, count_if(first_day is null) as missing, count(first_day) / count(*) as rate from r group by 1""",
    "duplicate_bookings": f"""with {ATTEND} select person, count(*) as bookings, arg_min(name, row_no) as name, string_agg(distinct cast(start_date as varchar), ',' order by cast(start_date as varchar)) as days,
        string_agg(distinct instructor, ',' order by instructor) as instructors from recs group by 1 having count(*) > 1""",
    "duplicate_rows": f"with {ATTEND} select * from (select person, row_no, count(*) over (partition by person) as bookings from recs) where bookings > 1",
    "roster_mismatch": f"""with {TRAIN}, s as (select project, start_date, end_date, case when employee_id <> '' then 'id:' || employee_id else 'name:' || name end as person, min(row_no) as row_no
            from train where not cancelled and project in ('航空安保', 'TSA') group by all),
        b as (select start_date, end_date from s group by 1, 2 having count(distinct project) = 2)
        select s.start_date, s.end_date, person, row_no, project as only_in from s join b using (start_date, end_date)
        where not exists (select 1 from s o where o.start_date = s.start_date and o.end_date = s.end_date and o.person = s.person and o.project <> s.project)""",
    "duplicate_ids": f"with {TRAIN} select employee_id, count(*) as n, min(row_no) as first_row, max(row_no) as last_row from train where employee_id <> '' group by 1 having count(*) > 1",
    "duplicate_id_rows": f"with {TRAIN}, k as (select employee_id, count(*) as n from train where employee_id <> '' group by 1 having count(*) > 1) select employee_id, row_no, n from train join k using (employee_id)",
    "id_integrity": f"""with {TRAIN} select project, count(*) as total, count_if(employee_id = '') as blank, count(nullif(employee_id, '')) - count(distinct nullif(employee_id, '')) as repeated,
        count_if(employee_id = '') = 0 and count(nullif(employee_id, '')) = count(distinct nullif(employee_id, '')) as valid from train group by 1""",
}
