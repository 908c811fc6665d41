"""SQL that computes the registered queries' results in DuckDB, for comparison.

Written for clarity on small data: overlaps by joining rows, order-dependent results by
recursion over each key's rows.
"""

from __future__ import annotations

from clinicflow.functions import texts
from clinicflow.sources.driver_tables import DUCKDB_NAMES, MOVEMENT_ORDER, PROJECTIONS, TABLES, sql
from clinicflow.sources.schemas import TABLES as DECLARED

_DERIVED = {
    "appointments": "appointment_time+duration_minutes*60 end_time",
    "bookings": "appointment_time+duration_minutes*60 end_time",
    "requests": "appointment_time+duration_minutes*60 end_time",
    "late_bookings": "appointment_time+duration_minutes*60 end_time",
    "coded_requests": "appointment_time+duration_minutes*60 end_time",
    "appointment_proposals": "appointment_time+duration_minutes*60 end_time",
    "holiday_rows": "year(date) as year",
    "inventory_items": "cast(current_stock-reserved_stock as decimal(10,2)) available_stock",
    "inventory_movements":
        "cast(abs(quantity)*coalesce(unit_cost,0) as decimal(12,2)) total_cost",
}

ORACLE: dict[str, str] = {}


def _table(name: str) -> str:
    text = sql(name, **DUCKDB_NAMES)
    if name in _DERIVED:
        text = f"select *, {_DERIVED[name]} from ({text}) base"
    return f"{name} as materialized ({text})"


def oracle(name: str, tables: str, body: str, steps: str = "") -> None:
    """Register SQL: the named clinic tables, further steps, then the final select."""
    parts = [_table(t) for t in tables.split()]
    if steps:
        parts.append(steps.strip().rstrip(","))
    ORACLE[name] = f"with recursive {', '.join(parts)} {body}"


NOW = "timestamp '2024-01-15 12:00:00'"
TODAY = "date '2024-01-15'"
ORDER = ", ".join(MOVEMENT_ORDER)


def _prefixed(alias: str) -> str:
    return ", ".join(f"{alias}.{c}" for c in MOVEMENT_ORDER)


# Scheduling

oracle("appointments_complete", "appointments users appointment_statuses", """
select a.id, a.appointment_code, a.appointment_date, a.appointment_time, a.end_time,
  a.duration_minutes, a.reason, a.priority, concat(p.first_name,' ',p.last_name) patient_name,
  p.document_number patient_dni, p.phone patient_phone,
  concat(d.first_name,' ',d.last_name) dentist_name, s.display_name status_name,
  s.color status_color, a.arrived_at, a.started_at, a.finished_at, a.created_at, a.updated_at
from appointments a join users p on a.patient_id=p.id join users d on a.dentist_id=d.id
join appointment_statuses s on a.status_id=s.id""")

_NAMES = "[" + ",".join(f"'{n}'" for n in texts.DAY_NAMES) + "]"
oracle("dentist_availability", "users working_hours", f"""
select w.dentist_id, concat(u.first_name,' ',u.last_name) dentist_name, w.day_of_week,
  {_NAMES}[w.day_of_week] day_name, w.start_time, w.end_time, w.break_start_time,
  w.break_end_time, w.valid_from, w.valid_until
from users u join working_hours w on u.id=w.dentist_id where w.is_active""")

oracle("appointment_end_times", "appointments",
       "select id, appointment_time, duration_minutes, end_time from appointments")

_CLASH = """x.dentist_id=y.dentist_id and x.appointment_date=y.appointment_date
  and x.appointment_time<y.end_time and y.appointment_time<x.end_time"""

oracle("appointment_overlaps", "appointments", f"""
select x.id, count(y.id) as overlaps from appointments x left join appointments y
on {_CLASH} and x.id<>y.id group by x.id""")

oracle("appointment_overlap_flags", "appointments", f"""
select x.id, count(y.id)>0 overlaps_earlier from appointments x left join appointments y
on {_CLASH} and (y.appointment_time,y.id)<(x.appointment_time,x.id) group by x.id""")

_IN_HOURS = """exists(select 1 from working_hours w where w.is_active
  and w.dentist_id=x.dentist_id and w.day_of_week=isodow(x.appointment_date)
  and x.appointment_date>=w.valid_from
  and (w.valid_until is null or x.appointment_date<=w.valid_until)
  and x.appointment_time>=w.start_time and x.end_time<=w.end_time)"""
_ON_HOLIDAY = "exists(select 1 from holidays h where h.is_active and h.date=x.appointment_date)"

oracle("appointments_in_hours", "appointments working_hours",
       f"select x.id, x.dentist_id from appointments x where {_IN_HOURS}")

oracle("appointments_on_holidays", "appointments holidays",
       f"select x.id, x.appointment_date from appointments x where {_ON_HOLIDAY}")

oracle("appointment_overlap_active", "requests bookings appointment_statuses", f"""
select x.id, count(y.id) as overlaps, count(y.id)=0 is_accepted,
  case when count(y.id)>0 then '{texts.ACTIVE_SLOT_TAKEN}' end message
from requests x left join (select b.* from bookings b join appointment_statuses s
  on b.status_id=s.id where s.name not in ('cancelled','no_show')) y on {_CLASH}
group by x.id""")

oracle("appointment_conflicts", "requests bookings", f"""
select x.id request_id, y.id visit_id, x.dentist_id, x.appointment_date,
  greatest(x.appointment_time,y.appointment_time) shared_from, least(x.end_time,y.end_time) shared_until
from requests x join bookings y on {_CLASH} and x.id<>y.id""")

oracle("appointment_first_conflicts", "requests bookings", f"""
select id, blocked_by, blocked_from, blocked_until from (
  select x.id, y.id blocked_by, y.appointment_time blocked_from, y.end_time blocked_until,
    row_number() over (partition by x.id order by y.appointment_time, y.end_time desc, y.id) rn
  from requests x left join bookings y on {_CLASH}) p where rn=1""")


def _greedy(candidates: str) -> str:
    """Grant candidate visits in order of id unless they overlap one granted before."""
    return f"""
lined as (select *, row_number() over (partition by dentist_id, appointment_date order by id) rn
  from {candidates}),
walk as (
  select dentist_id, appointment_date, 0::bigint rn,
    []::struct(s int, e int)[] taken, null::bigint id, false granted
  from (select distinct dentist_id, appointment_date from lined) d
  union all
  select dentist_id, appointment_date, rn,
    case when free then list_append(taken, {{'s': s, 'e': e}}) else taken end, id, free
  from (
    select l.dentist_id, l.appointment_date, l.rn, w.taken, l.id, l.appointment_time s,
      l.end_time e,
      len(list_filter(w.taken, lambda t: t.s<l.end_time and t.e>l.appointment_time))=0 free
    from walk w join lined l on l.dentist_id=w.dentist_id
      and l.appointment_date=w.appointment_date and l.rn=w.rn+1) n)"""


_REASON = f"""case when holiday then '{texts.HOLIDAY}'
  when not open then '{texts.OUTSIDE_HOURS}' when not granted then '{texts.SLOT_TAKEN}' end"""

oracle("appointment_admission", "requests bookings working_hours holidays", """
select id, dentist_id, appointment_date, appointment_time, end_time,
  case when message is null and n<=9999 then month||'-'||lpad(cast(n as varchar),4,'0') end appointment_code,
  message is null and n<=9999 is_accepted,
  case when message is not null then message when n>9999 then '%s' end message
from numbered""" % texts.CODES_EXHAUSTED, f"""
judged as (select x.*, {_ON_HOLIDAY} holiday, {_IN_HOURS} open,
  exists(select 1 from bookings y where {_CLASH}) booked from requests x),
able as (select * from judged where not holiday and open and not booked),
{_greedy('able')},
decided as (select j.*, {_REASON} message,
    'CITA-'||strftime(j.appointment_date,'%Y%m') as month
  from (select j.*, coalesce(w.granted,false) granted from judged j
    left join walk w on w.id=j.id) j),
used as (select substr(appointment_code,1,11) as month, max(cast(right(appointment_code,4) as int)) last
  from bookings group by 1),
numbered as (select d.*, coalesce(u.last,0)
    + sum(case when d.message is null then 1 else 0 end) over (partition by d.month order by d.id) n
  from decided d left join used u on u.month=d.month)""")

oracle("appointment_admission_codes", "coded_requests late_bookings working_hours holidays", f"""
select j.id, case when w.why is null and able then j.month||'-'||lpad(cast(w.n as varchar),4,'0') end appointment_code,
  coalesce(w.why is null and able, false) is_accepted,
  case when j.holiday then '{texts.HOLIDAY}' when not j.open then '{texts.OUTSIDE_HOURS}'
    when j.booked then '{texts.SLOT_TAKEN}' else w.why end message
from judged j left join walk w on w.id=j.id""", f"""
seen as (select x.*, {_ON_HOLIDAY} holiday, {_IN_HOURS} open,
  exists(select 1 from late_bookings y where {_CLASH}) booked,
  appointment_code in (select appointment_code from late_bookings) code_stored,
  cast(right(appointment_code,4) as int) own, 'CITA-'||strftime(appointment_date,'%Y%m') as month from coded_requests x),
judged as (select *, not holiday and open and not booked able from seen),
lined as (select *, row_number() over (partition by month order by id) rn from judged where able),
walk as (
  select m.month, 0::bigint rn, []::struct(dentist_id bigint, d date, s int, e int)[] taken, []::int[] used,
    coalesce((select max(cast(right(appointment_code,4) as int)) from late_bookings b
      where left(b.appointment_code,11)=m.month),0) as last, null::bigint id, null::int n, null::varchar why
  from (select distinct month from lined) m
  union all
  select month, rn,
    case when why is null then list_append(taken, {{{{'dentist_id': dentist_id, 'd': d, 's': s, 'e': e}}}}) else taken end,
    case when why is null then list_append(used, n) else used end,
    case when why is null then greatest(last, n) else last end, id, n, why
  from (
    select l.month, l.rn, w.taken, w.used, w.last, l.id, l.dentist_id, l.appointment_date d, l.appointment_time s,
      l.end_time e, coalesce(l.own, w.last+1) n,
      case when len(list_filter(w.taken, lambda t: t.dentist_id=l.dentist_id and t.d=l.appointment_date
          and t.s<l.end_time and t.e>l.appointment_time))>0 then '{texts.SLOT_TAKEN}'
        when l.own is not null and (l.code_stored or list_contains(w.used, l.own)) then '{texts.CODE_TAKEN}'
        when l.own is null and w.last>=9999 then '{texts.CODES_EXHAUSTED}' end why
    from walk w join lined l on l.month=w.month and l.rn=w.rn+1) n)""".replace("{{", "{").replace("}}", "}"))

oracle("appointment_changes", "appointments appointment_proposals working_hours holidays", """
select n.id, case when ok then n.dentist_id else o.dentist_id end dentist_id,
  case when ok then n.appointment_date else o.appointment_date end appointment_date,
  case when ok then n.appointment_time else o.appointment_time end appointment_time,
  case when ok then n.end_time else o.end_time end end_time,
  case when ok then n.reason else o.reason end reason,
  cast(o.version + case when ok then 1 else 0 end as int) as version,
  n.moved, ok is_accepted, n.message
from (select *, message is null ok from decided) n join appointments o on o.id=n.id""", f"""
proposals as (select n.*, n.appointment_date<>o.appointment_date
    or n.appointment_time<>o.appointment_time or n.duration_minutes<>o.duration_minutes
    or n.dentist_id<>o.dentist_id moved
  from appointment_proposals n join appointments o on o.id=n.id),
judged as (select x.*, {_ON_HOLIDAY} holiday, {_IN_HOURS} open from proposals x where moved),
able as (select n.id, n.dentist_id, n.appointment_date, n.appointment_time, n.end_time,
    o.dentist_id old_dentist, o.appointment_date old_date, o.appointment_time old_start, o.end_time old_end
  from judged n join appointments o on o.id=n.id where not holiday and open),
pairs as (select x.id, y.id other, y.old_dentist=x.dentist_id and y.old_date=x.appointment_date
    and y.old_start<x.end_time and x.appointment_time<y.old_end was,
    {_CLASH} wants from able x join able y on x.id<>y.id
    and ((y.old_dentist=x.dentist_id and y.old_date=x.appointment_date)
      or (y.dentist_id=x.dentist_id and y.appointment_date=x.appointment_date))),
earlier as materialized (select * from pairs where other<id and (was or wants)),
fixed as (select x.id, exists(select 1 from appointments y where {_CLASH} and y.id<>x.id
      and y.id not in (select id from able))
    or exists(select 1 from pairs p where p.id=x.id and p.other>x.id and p.was) blocked from able x),
walk as (
  select id, case when blocked then false when id not in (select id from earlier) then true end granted, 0 n from fixed
  union all
  select w.id, coalesce(w.granted, x.granted), w.n+1
  from walk w left join (select e.id, case when bool_or(case when o.granted then e.wants when not o.granted then e.was end)
      then false when bool_or(o.granted is null) then null else true end granted
    from earlier e join walk o on o.id=e.other group by e.id) x on x.id=w.id
  where exists(select 1 from walk where granted is null)),
decided as (select p.*, case when p.moved then {_REASON} end message
  from (select p.*, j.holiday, j.open, coalesce(w.granted,false) granted from proposals p
    left join judged j on j.id=p.id left join (select * from walk where n=(select max(n) from walk)) w on w.id=p.id) p)""")

oracle("appointment_reminder_plan", "appointments", f"""
select id appointment_id, 'email' reminder_type, 24 hours_before,
  cast(appointment_date as timestamp) + to_seconds(appointment_time-24*3600) send_at from appointments
union all
select id, 'sms', 2, cast(appointment_date as timestamp) + to_seconds(appointment_time-2*3600)
from appointments where appointment_date={TODAY}+1""")

# Billing

_LINES = """
g as (select *, cast(quantity*unit_price as decimal(10,2)) gross_amount from invoice_details),
d as (select *, cast(gross_amount*discount_percentage*0.01 as decimal(8,2)) discount_amount from g),
s as (select *, cast(gross_amount-discount_amount as decimal(10,2)) subtotal from d),
x as (select *, cast(subtotal*tax_percentage*0.01 as decimal(8,2)) tax_amount from s),
lines as (select *, cast(subtotal+tax_amount as decimal(10,2)) total_price from x)"""
_TOTALS = _LINES + """,
sums as (select invoice_id, sum(subtotal) subtotal, sum(discount_amount) discount_amount,
  sum(tax_amount) tax_amount, sum(total_price) total_amount from lines group by 1),
totals as (select i.id, i.series, i.correlative, i.patient_id, i.issue_date, i.due_date,
  cast(coalesce(s.subtotal,0) as decimal(10,2)) subtotal,
  cast(coalesce(s.discount_amount,0) as decimal(10,2)) discount_amount,
  cast(coalesce(s.tax_amount,0) as decimal(10,2)) tax_amount,
  cast(coalesce(s.total_amount,0) as decimal(10,2)) total_amount
  from invoices i left join sums s on s.invoice_id=i.id)"""

oracle("invoice_line_amounts", "invoice_details", "select * from lines", _LINES)
oracle("invoice_totals", "invoices invoice_details",
       "select * exclude (correlative, due_date) from totals", _TOTALS)
_HIT = "id in (select invoice_id from lines where discount_percentage=10)"
oracle("invoice_totals_refresh", "invoices invoice_details", f"""
select id,
  cast(case when {_HIT} then subtotal else 0 end as decimal(10,2)) subtotal,
  cast(case when {_HIT} then discount_amount else 0 end as decimal(10,2)) discount_amount,
  cast(case when {_HIT} then tax_amount else 0 end as decimal(10,2)) tax_amount,
  cast(case when {_HIT} then total_amount else 0 end as decimal(10,2)) total_amount
from totals""", _TOTALS)

oracle("last_correlatives", "invoices_supplied", """
select series, max(cast(correlative as bigint)) last_number from invoices_supplied group by 1""")

oracle("invoice_numbering", "invoices invoices_supplied", """
select id, series, lpad(cast(n as varchar),8,'0') correlative,
  concat(series,'-',lpad(cast(n as varchar),8,'0')) invoice_number
from (select i.id, i.series, coalesce(u.last,0)+row_number() over (partition by i.series order by i.id) n
  from invoices i left join (select series, max(cast(correlative as bigint)) last
    from invoices_supplied group by 1) u on u.series=i.series) n""")

oracle("invoice_admission", "invoices invoices_supplied", f"""
select i.id, i.series,
  case when i.correlative is null then lpad(cast(w.last as varchar),8,'0') else i.correlative end correlative,
  case when w.ok then concat(i.series,'-',
    case when i.correlative is null then lpad(cast(w.last as varchar),8,'0') else i.correlative end) end invoice_number,
  w.ok is_accepted, case when not w.ok then '{texts.NOT_SEQUENTIAL}' end message
from invoices_supplied i join walk w on w.id=i.id""", """
lined as (select *, row_number() over (partition by series order by id) rn from invoices_supplied),
walk as (
  select s.series, 0::bigint rn, case when e.series is null then 0 else 7 end::bigint last,
    null::bigint id, false ok
  from (select distinct series from lined) s
  left join (select distinct series from invoices) e on e.series=s.series
  union all
  select l.series, l.rn,
    case when l.correlative is null or cast(l.correlative as bigint)=w.last+1 then w.last+1 else w.last end,
    l.id, l.correlative is null or cast(l.correlative as bigint)=w.last+1
  from walk w join lined l on l.series=w.series and l.rn=w.rn+1)""")

oracle("invoice_detail_defaults", "invoice_details", """
select invoice_id, line_no, service_id, supplier_id, cast(1 as int) quantity, unit_price,
  cast(0 as decimal(5,2)) discount_percentage, cast(0 as decimal(8,2)) discount_amount,
  cast(18 as decimal(5,2)) tax_percentage, cast(0 as decimal(8,2)) tax_amount
from invoice_details""")

# Inventory

oracle("inventory_status", "inventory_items inventory_categories inventory_alerts", f"""
select i.id, i.code, i.name, c.name category_name, i.current_stock, i.minimum_stock,
  i.available_stock, i.unit_of_measure, i.unit_cost, i.location, i.has_expiration,
  i.expiration_date,
  case when current_stock=0 then '{texts.NO_STOCK}'
    when 2*current_stock<=minimum_stock then '{texts.CRITICAL}'
    when current_stock<=minimum_stock then '{texts.LOW}'
    when current_stock>=maximum_stock then '{texts.EXCESS}' else '{texts.NORMAL}' end stock_status,
  (select count(*) from inventory_alerts a where a.item_id=i.id and not a.is_resolved) active_alerts,
  i.is_active
from inventory_items i join inventory_categories c on i.category_id=c.id""")

oracle("critical_stock_report", "inventory_items inventory_categories inventory_movements", f"""
select i.code, i.name, c.name category, i.current_stock, i.minimum_stock, i.unit_of_measure,
  i.location, i.primary_supplier,
  case when current_stock=0 then '{texts.NO_STOCK}'
    when 2*current_stock<=minimum_stock then '{texts.CRITICAL}' else '{texts.LOW}' end status,
  cast({TODAY}-cast(coalesce(m.last,i.created_at) as date) as int) days_since_last_purchase,
  cast(i.unit_cost*(i.minimum_stock*2) as decimal(24,4)) recommended_purchase_value
from inventory_items i join inventory_categories c on i.category_id=c.id
left join (select item_id, max(created_at) last from inventory_movements
  where movement_type='purchase' group by 1) m on m.item_id=i.id
where i.current_stock<=i.minimum_stock and i.is_active""")

_CATEGORY = """case when movement_type in ('purchase','return') then 'in'
  when movement_type in ('consumption','waste','expired','transfer') then 'out'
  else 'adjustment' end"""

oracle("movement_category", "inventory_movements",
       f"select item_id, {ORDER}, total_cost, {_CATEGORY} movement_category from inventory_movements")

oracle("item_available_stock", "inventory_items",
       "select id, current_stock, reserved_stock, available_stock from inventory_items")

_LINED = "row_number() over (partition by item_id order by " + ORDER + ") rn"

oracle("movement_validation", "movement_claims inventory_items", f"""
select m.item_id, {_prefixed('m')}, m.movement_category, m.previous_stock, m.new_stock, m.unit_cost,
  m.movement_type in ('waste','expired','adjustment') and abs(m.quantity)>100 and w.why is null approval_required,
  not (m.movement_type in ('waste','expired','adjustment') and abs(m.quantity)>100 and w.why is null) is_approved,
  w.why message, w.why is null is_accepted
from lined m join walk w on w.item_id=m.item_id and w.rn=m.rn""", f"""
lined as (select *, {_LINED} from movement_claims),
walk as (
  select id item_id, 0::bigint rn, current_stock stock, is_active active, null::varchar why
  from inventory_items
  union all
  select item_id, rn, case when why is null then new_stock else stock end, active, why
  from (select l.item_id, l.rn, l.new_stock, w.stock, w.active,
      case when not w.active then '{texts.INACTIVE_ITEM}'
        when l.previous_stock<>w.stock then '{texts.STALE_STOCK}'
        when l.new_stock<0 then '{texts.NEGATIVE_STOCK}'
        when l.movement_category in ('in','out') and l.new_stock<>l.previous_stock+l.quantity
          then '{texts.WRONG_STOCK}' end why
    from walk w join lined l on l.item_id=w.item_id and l.rn=w.rn+1) n)""")

oracle("ledger_continuity", "movement_claims", f"""
select * from (
  select item_id, {ORDER}, movement_category, previous_stock, new_stock, unit_cost,
    approval_required, is_approved, expected_stock, coalesce(previous_stock<>expected_stock,false) breaks_chain,
    coalesce(movement_category in ('in','out') and new_stock<>previous_stock+quantity,false) wrong_sum
  from (select *, lag(new_stock) over (partition by item_id order by {ORDER}) expected_stock
    from movement_claims) c) r
where breaks_chain or wrong_sum""")

oracle("running_stock", "inventory_movements inventory_items", f"""
select m.item_id, {_prefixed('m')}, cast(coalesce(i.current_stock,0)
  + sum(m.quantity) over (partition by m.item_id order by {_prefixed('m')}
      rows unbounded preceding) as decimal(18,2)) running_stock
from inventory_movements m left join inventory_items i on i.id=m.item_id""")


def _posting(weight: str = "stock") -> str:
    """Post movements row by row; stock in hundredths, costs in cents, batches as a map."""
    return f"""
shelves as (select item_id, map_from_entries(list((lower(rtrim(batch_number)), cast(quantity_current*100 as bigint)))) held
  from inventory_batches group by 1),
requested as (select *, {_CATEGORY} movement_category, cast(quantity*100 as bigint) q,
  case when {_CATEGORY}='out' then lower(rtrim(batch_number)) end batch,
  cast(unit_cost*100 as hugeint) p, {_LINED} from inventory_movements),
walk as (
  select id item_id, 0::bigint rn, cast(current_stock*100 as bigint) stock,
    cast(unit_cost*100 as hugeint) average, cast(last_purchase_cost*100 as hugeint) bought,
    cast(minimum_stock*100 as bigint) minimum, 0::bigint episode, 0::bigint next_episode,
    null::bigint was, null::varchar why, coalesce(held, map_from_entries([('', 0::bigint)])) held
  from inventory_items left join shelves on shelves.item_id=inventory_items.id where is_active
  union all
  select item_id, rn, case when why is null then after else stock end,
    case when why is null and movement_category='in' and p is not null then
      case when {weight}>0 then (2*({weight}*average+q*p)+{weight}+q)//(2*({weight}+q)) else p end
      else average end,
    case when why is null and movement_type='purchase' and p is not null then p else bought end,
    minimum, next_episode,
    next_episode + case when why is null and movement_category='in' and after>minimum then 1 else 0 end,
    stock, why,
    case when why is null and held[batch] is not null then map_concat(held, map_from_entries([(batch, held[batch]+q)]))
      else held end
  from (select r.item_id, r.rn, r.q, r.p, r.movement_category, r.movement_type, w.minimum, r.batch, w.held,
      w.next_episode, cast(w.stock as hugeint) stock, cast(w.stock+r.q as hugeint) after, w.average, w.bought,
      case when r.movement_category='out' and w.stock+r.q<0 then '{texts.NOT_ENOUGH}'
        when w.stock+r.q<0 or w.held[r.batch]+r.q<0 then '{texts.MOVEMENT_FAILED}' end why
    from walk w join requested r on r.item_id=w.item_id and r.rn=w.rn+1) n),
posted as (select r.*, w.item_id is not null and w.why is null is_accepted,
    case when w.item_id is null then '{texts.UNKNOWN_ITEM}' else coalesce(w.why,'{texts.MOVEMENT_DONE}') end message,
    cast(w.was*0.01 as decimal(10,2)) previous_stock,
    case when w.why is null then cast(cast(w.stock as bigint)*0.01 as decimal(10,2)) end new_stock,
    cast(cast(w.average as bigint)*0.01 as decimal(10,2)) average_cost,
    cast(cast(w.bought as bigint)*0.01 as decimal(10,2)) last_purchase_cost, w.episode
  from requested r left join walk w on w.item_id=r.item_id and w.rn=r.rn)"""


_LARGE = """is_accepted and movement_type in ('waste','expired','adjustment') and abs(quantity)>100"""
oracle("movement_admission", "inventory_movements inventory_items inventory_batches", f"""
select item_id, {ORDER}, movement_category, is_accepted, message, previous_stock, new_stock,
  {_LARGE} approval_required, not ({_LARGE}) is_approved from posted""", _posting())

_LEDGER = f"""select item_id, {ORDER}, previous_stock, new_stock, average_cost,
  last_purchase_cost from posted where is_accepted"""
oracle("stock_ledger", "inventory_movements inventory_items inventory_batches", _LEDGER, _posting())
oracle("stock_ledger_as_written", "inventory_movements inventory_items inventory_batches", _LEDGER, _posting("after"))

_ITEMS_AFTER = """
select i.id, coalesce(p.new_stock,i.current_stock) current_stock,
  cast(coalesce(p.new_stock,i.current_stock)-i.reserved_stock as decimal(10,2)) available_stock,
  coalesce(p.average_cost,i.unit_cost) unit_cost,
  coalesce(p.last_purchase_cost,i.last_purchase_cost) last_purchase_cost
from inventory_items i left join (select * from posted where is_accepted
  qualify row_number() over (partition by item_id order by rn desc)=1) p on p.item_id=i.id"""
oracle("item_state_after", "inventory_movements inventory_items inventory_batches", _ITEMS_AFTER, _posting())

_BATCHES_AFTER = """
select b.id, b.item_id, b.batch_number,
  cast(b.quantity_current+coalesce(m.taken,0) as decimal(18,2)) quantity_current
from inventory_batches b left join (select item_id, batch, sum(quantity) taken
  from posted where is_accepted and batch is not null group by 1,2) m
on m.item_id=b.item_id and m.batch=lower(rtrim(b.batch_number))"""
oracle("batch_balance", "inventory_batches inventory_movements inventory_items", _BATCHES_AFTER, _posting())

oracle("batches_deactivate", "inventory_batches",
       "select id, is_active and quantity_current<>0 is_active from inventory_batches")

# Alerts

_ALERT = """item_id, alert_type, alert_level, title, message, threshold_value, current_value,
  expiration_date, batch_number, is_read, is_resolved, resolved_at, auto_resolve_date,
  created_at, updated_at"""

oracle("pending_alerts", "inventory_alerts inventory_items inventory_categories", """
select a.id, a.alert_type, a.alert_level, a.title, a.message, i.code item_code, i.name item_name,
  c.name category_name, a.current_value, a.threshold_value, a.expiration_date, a.created_at,
  case when a.alert_type='expired' then 1
    when a.alert_level='critical' then case a.alert_type when 'expiring_soon' then 2 else 3 end
    when a.alert_level='warning' then 4 else 5 end priority_order
from inventory_alerts a join inventory_items i on a.item_id=i.id
join inventory_categories c on i.category_id=c.id where not a.is_resolved""")

_FEED = f"""
able as (select *, expiration_date-{TODAY} as days, strftime(expiration_date,'%d/%m/%Y') written
  from inventory_items where has_expiration and is_active and current_stock>0),
feed as (
  select id item_id, 'expiring_soon' alert_type,
    case when days<=7 then 'critical' when days<=15 then 'warning' else 'info' end alert_level,
    concat('Vence: ',name,' (',days,' días)') title,
    concat('Artículo "',name,'" vence ',written) message, expiration_date, null::varchar batch_number
  from able where days<=coalesce(expiration_alert_days,30)
  union all
  select id, 'expired', 'critical', concat('VENCIDO: ',name),
    concat('Artículo "',name,'" venció ',written), expiration_date, null
  from able where days<0
  union all
  select b.item_id, 'batch_depleted', 'info', concat('Lote agotado: ',i.name),
    concat('Lote "',b.batch_number,'" del artículo "',i.name,'" se ha agotado'), null, b.batch_number
  from inventory_batches b join inventory_items i on b.item_id=i.id
  where b.quantity_current=0 and b.is_active
  qualify row_number() over (partition by b.item_id order by b.id)=1)"""

oracle("expiration_feed", "inventory_items inventory_batches",
       f"select *, {NOW} created_at from feed", _FEED)

_OLD = f"auto_resolve_date is not null and auto_resolve_date<{NOW} - interval 30 day"
oracle("alerts_purge", "inventory_alerts",
       f"select id, auto_resolve_date from inventory_alerts where not ({_OLD})")

oracle("expiration_alerts", "inventory_alerts inventory_items inventory_batches", f"""
select a.id, a.item_id, a.alert_type,
  case when f.alert_type='expiring_soon' then f.alert_level else a.alert_level end alert_level,
  a.title, case when f.alert_type='expiring_soon' then f.message else a.message end message,
  a.threshold_value, a.current_value, a.expiration_date, a.batch_number, a.is_read,
  a.is_resolved, a.resolved_at, a.auto_resolve_date, a.created_at,
  case when f.alert_type is not null then {NOW} else a.updated_at end updated_at
from kept a left join feed f on f.item_id=a.item_id and f.alert_type=a.alert_type and not a.is_resolved
union all
select null, f.item_id, f.alert_type, f.alert_level, f.title, f.message, null, null,
  f.expiration_date, f.batch_number, false, false, null, null, {NOW},
  case when f.alert_type='batch_depleted' and (select count(*) from inventory_batches b
    where b.item_id=f.item_id and b.quantity_current=0 and b.is_active)>1 then {NOW} end
from feed f where not exists(select 1 from kept a where not a.is_resolved
  and a.item_id=f.item_id and a.alert_type=f.alert_type)""",
       _FEED + f", kept as (select * from inventory_alerts where not ({_OLD}))")

_ALERTS_AFTER = """
select * from (
select a.id, a.item_id, a.alert_type, coalesce(e.level,a.alert_level) alert_level, a.title,
  a.message, a.threshold_value, coalesce(e.latest,a.current_value) current_value,
  a.expiration_date, a.batch_number, a.is_read,
  case when e.item_id is null then a.is_resolved else e.resolved is not null end is_resolved,
  coalesce(e.resolved,a.resolved_at) resolved_at,
  coalesce(e.resolved,a.auto_resolve_date) auto_resolve_date, a.created_at,
  coalesce(e.seen,a.updated_at) updated_at
from inventory_alerts a left join episodes e on e.item_id=a.item_id and e.episode=0
  and a.alert_type='low_stock' and not a.is_resolved
union all
select null, e.item_id, 'low_stock', e.level,
  concat(case when e.opened=0 then 'SIN STOCK: ' else 'Stock bajo: ' end, e.name),
  concat('Artículo "',e.name,'" - Stock actual: ',e.opened,', Mínimo: ',e.minimum_stock),
  e.minimum_stock, e.latest, null, null, false, e.resolved is not null, e.resolved, e.resolved,
  e.since, case when e.readings>1 then e.seen end
from episodes e where e.readings>0 and not (e.episode=0 and exists(
  select 1 from inventory_alerts a where a.item_id=e.item_id and a.alert_type='low_stock'
  and not a.is_resolved))) x"""
_EPISODES = _posting() + """,
seen as (select p.*, i.name, i.minimum_stock, p.new_stock<=i.minimum_stock low,
    p.movement_category='in' and p.new_stock>i.minimum_stock full_again
  from posted p join inventory_items i on i.id=p.item_id where p.is_accepted),
episodes as (select item_id, name, minimum_stock, episode,
    count(*) filter (low) readings,
    arg_min(new_stock, rn) filter (low) opened, arg_min(created_at, rn) filter (low) since,
    arg_max(new_stock, rn) filter (low) latest, arg_max(created_at, rn) filter (low) seen,
    case when arg_max(new_stock, rn) filter (low)=0 then 'critical'
      when count(*) filter (low)>0 then 'warning' end level,
    max(created_at) filter (full_again) resolved
  from seen where low or full_again group by all)"""
oracle("low_stock_alerts", "inventory_alerts inventory_movements inventory_items inventory_batches", _ALERTS_AFTER, _EPISODES)

oracle("movement_batch", "inventory_alerts inventory_movements inventory_items inventory_batches", f"""
select 'inventory_movements' table_name, item_id, concat_ws('|',strftime(created_at,'%Y-%m-%d %H:%M:%S'),order_no,line_no,
    supplier_id,movement_type,quantity) ref, cast(new_stock as decimal(18,2)) amount,
  cast(average_cost as decimal(18,2)) as cost, message fact from posted
union all
select 'inventory_items', id, null, cast(current_stock as decimal(18,2)), cast(unit_cost as decimal(18,2)), null
from ({_ITEMS_AFTER}) i
union all
select 'inventory_batches', item_id, cast(id as varchar), quantity_current, null, batch_number from ({_BATCHES_AFTER}) b
union all
select 'inventory_alerts', item_id, cast(id as varchar), cast(current_value as decimal(18,2)), null,
  concat_ws('|',alert_type,alert_level,case when is_resolved then 'resolved' else 'open' end) from ({_ALERTS_AFTER}) a""",
       _EPISODES)

oracle("alerts_resolve_replenished", "inventory_alerts inventory_movements inventory_items inventory_batches", """
select a.id, a.is_resolved or f.since is not null is_resolved,
  coalesce(f.since,a.resolved_at) resolved_at, coalesce(f.since,a.auto_resolve_date) auto_resolve_date
from inventory_alerts a left join (
  select p.item_id, min(p.created_at) since from posted p join inventory_items i on i.id=p.item_id
  where p.is_accepted and p.movement_category='in' and p.new_stock>i.minimum_stock group by 1) f
on f.item_id=a.item_id and a.alert_type='low_stock' and not a.is_resolved""", _posting())

_EMPTY = """a.alert_type='expiring_soon' and not a.is_resolved and not a.is_read
  and i.current_stock=0"""
oracle("alerts_resolve_empty", "inventory_alerts inventory_items", f"""
select a.id, a.is_resolved or coalesce({_EMPTY},false) is_resolved,
  case when {_EMPTY} then {NOW} else a.auto_resolve_date end auto_resolve_date
from inventory_alerts a left join inventory_items i on i.id=a.item_id""")

# Documents

oracle("code_generation",
       "requests bookings medical_records prescriptions laboratory_orders", """
select kind, id, case when n<=9999 then kind||'-202401-'||lpad(cast(n as varchar),4,'0') end code,
  n>9999 code_overflow
from (
  select 'CITA' kind, id, row_number() over (order by id) + (
    select max(cast(right(appointment_code,4) as int)) from bookings
    where appointment_code like 'CITA-202401-%') n from requests
  union all select 'HC', id, row_number() over (order by id) from medical_records
  union all select 'RX', id, row_number() over (order by id) from prescriptions
  union all select 'LAB', id, row_number() over (order by id) from laboratory_orders) c""")

oracle("lab_order_tests", "laboratory_orders", """
select id, unnest(from_json(tests_requested,'["varchar"]')) test from laboratory_orders""")

# Users

_SIX = """'document_type', {0}.document_type, 'document_number', {0}.document_number,
  'email', {0}.email, 'first_name', {0}.first_name, 'last_name', {0}.last_name, 'role_id', {0}.role_id"""


def _json(alias: str, more: str = "") -> str:
    return f"cast(json_object({_SIX.format(alias)}{more.format(alias)}) as varchar)"


_ACTIVE = ", 'is_active', cast({0}.is_active as int)"
oracle("user_audit_insert", "users", f"""
select n.id user_id, 'users' table_name, n.id record_id, 'CREATE' action,
  {_json('n')} new_values, {NOW} created_at from users n""")
oracle("user_audit_update", "users users_new", f"""
select n.id user_id, 'users' table_name, n.id record_id, 'UPDATE' action,
  {_json('o', _ACTIVE)} old_values, {_json('n', _ACTIVE)} new_values, {NOW} created_at
from users_new n join users o on o.id=n.id""")
_THREE = """cast(json_object('email', {0}.email, 'is_active', cast({0}.is_active as int),
  'role_id', {0}.role_id) as varchar)"""
oracle("user_audit_critical", "users users_new", f"""
select n.id user_id, 'users' table_name, n.id record_id, 'update' action,
  {_THREE.format('o')} old_values, {_THREE.format('n')} new_values, 'high' risk_level,
  {NOW} created_at
from users_new n join users o on o.id=n.id
where n.email<>o.email or n.is_active<>o.is_active or n.role_id<>o.role_id""")

oracle("login_reset", "users users_new", """
select id, last_login, case when hit then 0 else failed_login_attempts end failed_login_attempts,
  case when not hit then last_failed_login end last_failed_login,
  case when not hit then locked_until end locked_until
from (select n.*, n.last_login is not null and n.last_login is distinct from o.last_login hit
  from users_new n join users o on o.id=n.id) x""")

oracle("password_rotation", "users users_new", f"""
select n.id, case when n.password<>o.password then o.jwt_version+1 else n.jwt_version end jwt_version,
  case when n.password<>o.password then {NOW} else n.password_changed_at end password_changed_at,
  case when n.password=o.password then n.session_id end session_id
from users_new n join users o on o.id=n.id""")

# Data quality


def _report(*rules: tuple[str, str, str]) -> str:
    return " union all ".join(
        f"select '{table.split(':')[-1]}' table_name, '{rule}' as rule, id from {table.split(':')[0]} where {broken}"
        for table, rule, broken in rules
    )


oracle("dq_not_null", "asked_visits medical_records invoices audit_logs support_tickets", _report(
    ("asked_visits:appointments", "appointment_code", "appointment_code is null"),
    ("medical_records", "record_number", "record_number is null"),
    ("invoices", "correlative", "correlative is null"),
    ("support_tickets", "title", "title is null"),
    ("support_tickets", "status", "status is null"),
))

oracle("dq_domain", "inventory_batches inventory_movements support_tickets user_profiles", f"""
select 'inventory_batches' table_name, 'quantity_current too small' as rule, id from (
  select b.id, b.quantity_current+coalesce(m.taken,0) is_left
  from inventory_batches b left join (select item_id, batch_number, sum(quantity) taken
    from inventory_movements where {_CATEGORY}='out' group by 1,2) m
  on m.item_id=b.item_id and m.batch_number=b.batch_number) x where is_left<0
union all """ + _report(
    ("support_tickets", "title too long", "length(title)>255"),
    ("support_tickets", "estimated_hours too large", "estimated_hours>=100"),
    ("user_profiles", "salary too small", "salary<0"),
))

oracle("dq_enum", "audit_logs support_tickets", _report(
    ("audit_logs", "action", "action not in ('insert','create','update','delete','login','logout','access_denied')"),
    ("audit_logs", "risk_level", "lower(rtrim(risk_level)) not in ('low','medium','high','critical')"),
    ("support_tickets", "category", "category='question'"),
    ("support_tickets", "priority", "priority='urgent'"),
))

oracle("dq_unique", "appointments support_tickets", """
select 'appointments' table_name, 'appointment_code' as rule, lower(appointment_code) key_value, count(*) copies, min(id) first_id
from appointments group by appointment_code having count(*)>1
union all
select 'appointments', 'dentist_id,appointment_date,appointment_time',
  concat(dentist_id,'|',appointment_date,'|',appointment_time), count(*), min(id)
from appointments group by dentist_id, appointment_date, appointment_time having count(*)>1
union all
select 'support_tickets', 'ticket_number', lower(ticket_number), count(*), min(id)
from support_tickets group by ticket_number having count(*)>1""")

def _declared(table: str, rows: str) -> list[str]:
    """Rows as JSON, so that the same text fits whichever columns they have."""
    fields = DECLARED[table].items()
    value = "json_extract_string(r.j, v.c)"

    def report(label: str, values: list[str], names: str, broken: str) -> list[str]:
        if not values:
            return []
        return [f"""select '{table}' table_name, v.c||' {label}' as rule, r.id
          from {rows}_json r, (values {', '.join(values)}) v({names}) where {broken}"""]

    number = f"try_cast({value} as decimal(38,2))"
    top = {n: f.high + 1 for n, f in fields if f.high is not None}
    top |= {n: 10 ** (f.type.precision - 2) for n, f in fields if f.type.typeName() == "decimal"}
    return [
        f"""select '{table}' table_name, v.c||' absent' as rule, cast(null as bigint) id from (values
          {', '.join(f"('{n}')" for n, f in fields if f.need and f.default is None)}) v(c)
          where not list_contains((select json_keys(j) from {rows}_json limit 1), v.c)""",
        *report("missing", [f"('{n}')" for n, f in fields if f.need], "c", "json_type(r.j, v.c)='NULL'"),
        *report("too long", [f"('{n}',{f.longest})" for n, f in fields if f.longest], "c, n", f"length({value})>v.n"),
        *report("too small", [f"('{n}',{f.low})" for n, f in fields if f.low is not None], "c, n", f"{number}<v.n"),
        *report("too large", [f"('{n}',{limit})" for n, limit in top.items()], "c, n", f"abs({number})>=v.n"),
        *report("not permitted", [f"('{n}','{'|'.join(f.choices).lower()}')" for n, f in fields if f.choices], "c, n",
                f"not list_contains(string_split(v.n,'|'), lower(rtrim({value})))"),
    ]


oracle("dq_declared", " ".join(PROJECTIONS.values()),
       " union all ".join(part for table, rows in PROJECTIONS.items() for part in _declared(table, rows)),
       ", ".join(f"{rows}_json as materialized (select id, to_json(p) j from {rows} p)" for rows in PROJECTIONS.values()))


def _repeated(table: str, rows: str, *columns: str, shown: str = "") -> str:
    compared = [c.replace("~", "") if "~" not in c else f"lower(rtrim({c[1:]}))" for c in columns]
    names = [c.replace("~", "") for c in columns]
    return f"""select '{table}' table_name, '{','.join(names)}' as rule, {shown or f"concat_ws('|',{','.join(compared)})"} key_value,
      count(*) copies, min(id) first_id from {rows} where {' and '.join(f'{n} is not null' for n in names)}
      group by {', '.join(compared)} having count(*)>1"""


oracle("dq_keys", " ".join(PROJECTIONS.values()), " union all ".join([
    *[_repeated(t, rows, "id") for t, rows in PROJECTIONS.items() if t not in ("invoice_details", "inventory_movements")],
    _repeated("appointments", "asked_visits", "~appointment_code"),
    _repeated("appointments", "asked_visits", "dentist_id", "appointment_date", "appointment_time"),
    _repeated("services", "service_rows", "~code"),
    _repeated("treatment_types", "treatment_type_rows", "~code"),
    _repeated("inventory_categories", "inventory_categories", "~category_code"),
    _repeated("inventory_items", "inventory_items", "~code"),
    _repeated("inventory_batches", "inventory_batches", "item_id", "~batch_number"),
    _repeated("inventory_alerts", "inventory_alerts", "item_id", "~alert_type", "is_resolved"),
    _repeated("support_tickets", "support_tickets", "~ticket_number"),
    _repeated("users", "users", "~email"), _repeated("users", "users", "~document_type", "~document_number"),
    _repeated("user_profiles", "profile_rows", "user_id"),
    _repeated("payment_methods", "method_rows", "~code"), _repeated("payment_methods", "method_rows", "~name", shown="min(name)"),
    _repeated("holidays", "holiday_rows", "~name", "is_recurring", "year", shown="concat_ws('|',min(name),is_recurring,year)"),
    _repeated("roles", "role_rows", "~name", shown="min(name)"),
    _repeated("permissions", "permission_rows", "~name", shown="min(name)"),
    _repeated("permissions", "permission_rows", "~module", "~action"),
    _repeated("role_permissions", "grant_rows", "role_id", "permission_id"),
    _repeated("system_configurations", "configuration_rows", "~category", "~key_name"),
]))

_LINKS = {
    "users": "asked_visits:appointments:patient_id asked_visits:appointments:dentist_id working_hours:working_hours:dentist_id "
        "unavailability_rows:appointment_unavailabilities:dentist_id unavailability_rows:appointment_unavailabilities:created_by "
        "unavailability_rows:appointment_unavailabilities:approved_by invoices:invoices:patient_id "
        "payment_rows:invoice_payments:processed_by movement_rows:inventory_movements:user_id "
        "movement_rows:inventory_movements:approved_by medical_records:medical_records:patient_id "
        "medical_records:medical_records:dentist_id file_rows:medical_record_files:uploaded_by "
        "prescriptions:prescriptions:patient_id prescriptions:prescriptions:dentist_id "
        "laboratory_orders:laboratory_orders:patient_id laboratory_orders:laboratory_orders:dentist_id "
        "notification_rows:notifications:user_id audit_logs:audit_logs:user_id support_tickets:support_tickets:user_id "
        "message_rows:support_ticket_messages:user_id configuration_rows:system_configurations:last_modified_by "
        "maintenance_rows:system_maintenance:created_by profile_rows:user_profiles:user_id",
    "appointments": "reminder_rows:appointment_reminders:appointment_id",
    "appointment_statuses": "asked_visits:appointments:status_id",
    "invoices": "line_rows:invoice_details:invoice_id payment_rows:invoice_payments:invoice_id",
    "payment_methods": "invoice_references:invoices:payment_method_id payment_rows:invoice_payments:payment_method_id",
    "services": "line_rows:invoice_details:service_id",
    "inventory_categories": "inventory_categories:inventory_categories:parent_id inventory_items:inventory_items:category_id",
    "inventory_items": "movement_rows:inventory_movements:item_id inventory_batches:inventory_batches:item_id "
        "inventory_alerts:inventory_alerts:item_id",
    "medical_records": "treatment_rows:treatment_records:medical_record_id file_rows:medical_record_files:medical_record_id",
    "treatment_types": "treatment_rows:treatment_records:treatment_type_id",
    "support_tickets": "message_rows:support_ticket_messages:ticket_id",
    "roles": "grant_rows:role_permissions:role_id users:users:role_id",
    "permissions": "grant_rows:role_permissions:permission_id",
}


def _lost(parent: str, link: str) -> str:
    rows, table, column = link.split(":")
    known = "select id from users_new where is_active" if parent == "users" else f"select id from {PROJECTIONS[parent]}"
    return f"""select '{table}' table_name, '{column} -> {parent}' as rule, cast(id as bigint) id, cast({column} as bigint) as value
      from {rows} where {column} is not null and {column} not in ({known})"""


oracle("dq_references", " ".join([*PROJECTIONS.values(), "users_new", "invoice_references"]),
       " union all ".join(_lost(parent, link) for parent, links in _LINKS.items() for link in links.split()))

_LOST = "not exists(select 1 from users_new u where u.is_active and u.id={0})"
oracle("dq_orphans", "appointments audit_logs inventory_alerts inventory_items users_new support_tickets", f"""
select 'appointments' table_name, 'patient_id -> users' as rule, id, patient_id as value
from appointments where {_LOST.format('patient_id')}
union all select 'appointments', 'dentist_id -> users', id, dentist_id
from appointments where {_LOST.format('dentist_id')}
union all select 'support_tickets', 'user_id -> users', id, user_id
from support_tickets where {_LOST.format('user_id')}
union all select 'audit_logs', 'user_id -> users', id, user_id
from audit_logs where user_id is not null and {_LOST.format('user_id')}
union all select 'inventory_alerts', 'item_id -> inventory_items', id, item_id
from inventory_alerts where not exists(select 1 from inventory_items i where i.is_active and i.id=item_id)""")

oracle("dq_checks",
       "appointments working_hours invoices invoice_details inventory_items inventory_batches "
       "inventory_categories medical_records prescriptions laboratory_orders audit_logs users "
       "movement_claims invoice_references user_limits category_places movement_approvals "
       "appointment_unavailabilities appointment_reminders services invoice_payments treatment_types "
       "treatment_records medical_record_files notifications support_ticket_messages "
       "system_maintenance user_profiles",
       _report(
    ("invoice_references:invoices", "payment reference",
     "payment_method_id is not null and strlen(payment_reference)<3"),
    ("user_limits:users", "lockouts", "lockout_count>50"),
    ("user_limits:users", "birth date", f"birth_date>{TODAY}"),
    ("category_places:inventory_categories", "sort order", "sort_order<0"),
    ("movement_approvals:inventory_movements", "approval",
     "approval_required and is_approved<>(approved_by is not null)"),
    ("appointment_unavailabilities", "dates", "end_date<start_date"),
    ("appointment_unavailabilities", "times",
     "(start_time is null)<>(end_time is null) or start_time>=end_time"),
    ("appointment_reminders", "retries", "retry_count>5"),
    ("appointment_reminders", "hours before", "hours_before<1 or hours_before>168"),
    ("appointment_reminders", "system hours before", "hours_before not in (1,2,6,12,24,48,72)"),
    ("services", "price", "price<0"),
    ("services", "duration", "duration_minutes not between 5 and 480"),
    ("invoice_payments", "amount", "amount<=0"),
    ("treatment_types", "duration", "estimated_duration not between 5 and 480"),
    ("treatment_types", "price", "base_price<0"),
    ("treatment_records", "price", "final_price<0"),
    ("treatment_records", "tooth number", "not regexp_full_match(tooth_number,'[1-8][1-8]')"),
    ("medical_record_files", "size", "file_size<=0"),
    ("medical_record_files", "file type", "file_type='text/html'"),
    ("notifications", "retries", "retry_count>5"),
    ("support_ticket_messages", "attachments", "not json_valid(attachments)"),
    ("system_maintenance", "dates", "ends_at<=starts_at"),
    ("system_maintenance", "modules", "not json_valid(affected_modules)"),
    ("user_profiles", "experience", "years_experience>70"),
    ("user_profiles", "salary", "salary<0"),
    ("appointments", "duration", "not duration_minutes between 15 and 480"),
    ("appointments", "date in the past", f"not appointment_date>={TODAY}"),
    ("appointments", "arrival times", f"""not ((arrived_at is null or arrived_at<=coalesce(started_at,{NOW}))
       and (started_at is null or started_at<=coalesce(finished_at,{NOW})))"""),
    ("appointments", "clinic hours", "not appointment_time between 25200 and 72000"),
    ("working_hours", "validity", "valid_until<valid_from"),
    ("totals:invoices", "amounts", "total_amount<>subtotal-discount_amount+tax_amount"),
    ("totals:invoices", "due date", "due_date<issue_date"),
    ("inventory_items", "stock", "reserved_stock>current_stock or maximum_stock<minimum_stock"),
    ("inventory_items", "expiration", "has_expiration and coalesce(expiration_alert_days,0)<=0"),
    ("inventory_batches", "quantity", "quantity_current>quantity_received or quantity_received<=0"),
    ("inventory_batches", "dates", "expiration_date<=purchase_date"),
    ("inventory_categories", "level", "level not between 1 and 5"),
    ("medical_records", "visit date", f"visit_date>{TODAY}"),
    ("medical_records", "next visit", "next_visit_date<=visit_date"),
    ("prescriptions", "date", f"prescription_date>{TODAY}"),
    ("prescriptions", "medications", "not json_valid(medications)"),
    ("laboratory_orders", "date", f"order_date>{TODAY}"),
    ("laboratory_orders", "tests", "not json_valid(tests_requested)"),
    ("audit_logs", "old values", "not json_valid(old_values)"),
    ("audit_logs", "new values", "not json_valid(new_values)"),
    ("users", "failed attempts", "failed_login_attempts>10"),
    ("users", "document", """document_type='CE' and not regexp_full_match(document_number,'[0-9]{9}')"""),
    ("invoice_lines:invoice_details", "quantity", "quantity<=0"),
    ("invoice_lines:invoice_details", "tax percentage", "tax_percentage not between 0 and 25"),
    ("movements:inventory_movements", "stock values", "previous_stock<0 or new_stock<0"),
    ("movements:inventory_movements", "quantity", """case movement_category when 'in' then quantity<=0
       when 'out' then quantity>=0 else false end"""),
       ), _TOTALS + """,
invoice_lines as (select *, invoice_id id from lines),
movements as (select *, order_no id from movement_claims)""")

# Deleting

oracle("delete_cascade", "invoices invoice_details", """
select invoice_id, line_no, service_id, supplier_id, quantity from invoice_details
where invoice_id not in (select id from invoices where o_orderstatus='F')""")
oracle("delete_set_null", "audit_logs users_new", """
select id, case when user_id not in (select id from users_new where not is_active) then user_id end user_id,
  record_id from audit_logs""")
oracle("delete_users", "users_new invoices appointments audit_logs working_hours medical_records prescriptions", """
select 'users' table_name, id, null::bigint reference from users_new where id not in (select id from removed)
union all
select 'audit_logs', id, case when user_id not in (select id from removed) then user_id end from audit_logs
union all
select 'working_hours', id, dentist_id from working_hours where dentist_id not in (select id from removed)
union all
select 'blocked', id, null from users_new where not is_active and id in (select id from used)""", """
used as (select patient_id id from invoices union select patient_id from appointments
  union select dentist_id from appointments union select patient_id from medical_records
  union select dentist_id from medical_records union select patient_id from prescriptions
  union select dentist_id from prescriptions),
removed as (select id from users_new where not is_active and id not in (select id from used))""")
oracle("delete_restrict", "invoices users_new", """
select id from users_new where not is_active and id in (select patient_id from invoices)""")

# Streams

oracle("stream_stock_state", "movement_claims inventory_items", f"""
select m.item_id, {_prefixed('m')}, w.why is null is_accepted, w.why message,
  cast(w.stock as decimal(10,2)) current_stock,
  cast(cast(w.average as bigint)*0.01 as decimal(10,2)) average_cost,
  cast(cast(w.bought as bigint)*0.01 as decimal(10,2)) last_purchase_cost
from lined m join walk w on w.item_id=m.item_id and w.rn=m.rn""", f"""
lined as (select *, cast(unit_cost*100 as hugeint) p, cast(quantity*100 as hugeint) q, {_LINED}
  from movement_claims),
walk as (
  select id item_id, 0::bigint rn, current_stock stock, cast(unit_cost*100 as hugeint) average,
    cast(last_purchase_cost*100 as hugeint) bought, is_active active, null::varchar why
  from inventory_items
  union all
  select item_id, rn, case when why is null then new_stock else stock end,
    case when why is null and movement_category='in' and p is not null then
      case when s>0 then (2*(s*average+q*p)+s+q)//(2*(s+q)) else p end else average end,
    case when why is null and movement_type='purchase' and p is not null then p else bought end,
    active, why
  from (select l.item_id, l.rn, l.new_stock, l.movement_category, l.movement_type, l.p, l.q,
      w.stock, cast(w.stock*100 as hugeint) s, w.average, w.bought, w.active,
      case when not w.active then '{texts.INACTIVE_ITEM}'
        when l.previous_stock<>w.stock then '{texts.STALE_STOCK}'
        when l.new_stock<0 then '{texts.NEGATIVE_STOCK}'
        when l.movement_category in ('in','out') and l.new_stock<>l.previous_stock+l.quantity
          then '{texts.WRONG_STOCK}' end why
    from walk w join lined l on l.item_id=w.item_id and l.rn=w.rn+1) n)""")
ORACLE["stream_reminders"] = ORACLE["appointment_reminder_plan"]

assert all(t in TABLES for t in _DERIVED)
