"""Clinic tables derived from the general test tables.

Each projection is written in SQL that Spark and DuckDB read alike, so both sides of a
comparison start from the same rows. `{str}` is the engine's text type; `{days}` yields the
weekdays 1 to 5 as rows. Every projection covers the whole source table.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession

from clinicflow.sources.tables import generated

AS_OF = date(2024, 1, 15)
NOW = datetime(2024, 1, 15, 12, 0, 0)

# Total order of movements; equal rows are equal in every column.
MOVEMENT_ORDER = [
    "created_at", "order_no", "line_no", "supplier_id", "movement_type", "quantity",
]

_VISIT = """
  event_id id, user_id*7%1500 patient_id, user_id%20 dentist_id,
  cast(ts as date) appointment_date,
  cast(hour(ts)*3600+minute(ts)*60 as int) appointment_time,
  cast(15*(1+event_id%4) as int) duration_minutes, event_type reason,
  1+event_id%8 status_id,
  case event_id%4 when 0 then 'baja' when 1 then 'normal' when 2 then 'alta' else 'urgente' end priority,
  cast(1+event_id%3 as int) version,
  case when event_id%5=0 then cast(ts as timestamp) end arrived_at,
  case when event_id%10=0 then cast(ts as timestamp) end started_at,
  cast(null as timestamp) finished_at, cast(ts as timestamp) created_at, cast(null as timestamp) updated_at
"""

_CODE_VALUE = """concat('CITA-', replace(substr(cast(cast(ts as date) as {str}),1,7),'-',''), '-',
  lpad(cast(event_id%1000 as {str}),4,'0'))"""
_CODE = f"{_CODE_VALUE} appointment_code"

_HOUR = """
  (d.dentist_id*10+d.day_of_week) id, d.dentist_id, d.day_of_week,
  cast(28800+(d.dentist_id%3)*3600 as int) start_time, 64800 end_time,
  case when d.dentist_id%2=0 then 46800 end break_start_time,
  case when d.dentist_id%2=0 then 50400 end break_end_time,
  d.dentist_id%7<>6 is_active, date '2024-01-01' valid_from,
  case when d.dentist_id%4=0 then date '2024-01-20' end valid_until
"""

TABLES: dict[str, str] = {
    "appointments": f"select {_CODE}, {_VISIT} from {{events}}",
    # One part of the visits is booked already, the other part asks for a slot.
    "bookings": f"select {_CODE}, {_VISIT} from {{events}} where event_type in ('purchase','signup')",
    "requests": f"""select cast(null as {{str}}) appointment_code, {_VISIT} from {{events}}
      where event_type is null or event_type not in ('purchase','signup')""",
    # The same where few numbers are left in a month, and some requests bring codes that may be in use.
    "late_bookings": f"""select concat('CITA-', replace(substr(cast(cast(ts as date) as {{str}}),1,7),'-',''), '-',
        cast(9700+event_id%200 as {{str}})) appointment_code, {_VISIT} from {{events}}
      where event_type in ('purchase','signup')""",
    "coded_requests": f"""select case when event_id%6=0 or event_id%611=0 then concat('CITA-',
        replace(substr(cast(cast(ts as date) as {{str}}),1,7),'-',''), '-',
        cast(case when event_id%6=0 then 9600+event_id%140 else 9900+event_id%100 end as {{str}})) end appointment_code,
      {_VISIT} from {{events}} where event_type is null or event_type not in ('purchase','signup')""",
    # All visits as they were asked for: only those booked have a code.
    "asked_visits": f"""select case when event_type in ('purchase','signup') then {_CODE_VALUE} end appointment_code,
      {_VISIT} from {{events}}""",
    # Proposed new versions: some visits move by half an hour or a day, or change dentist.
    "appointment_proposals": """
      select id, appointment_code, patient_id,
        case when id%9=0 then (dentist_id+1)%20 else dentist_id end dentist_id,
        case when id%7=0 then appointment_date+1 else appointment_date end appointment_date,
        case when id%5=0 then cast(36000+(id%13)*1800 as int) else appointment_time end appointment_time,
        duration_minutes, concat(reason,'*') reason, status_id, priority, version
      from (select {code}, {visit} from {events}) a""",
    "working_hours": f"""select {_HOUR} from
      (select dentist_id, {{days}} day_of_week from
        (select distinct user_id%20 dentist_id from {{events}}) x) d""",
    "holidays": """select * from (values
      (date '2024-01-01',true),(date '2024-01-08',false),(date '2024-01-15',true)
      ) h(date,is_active)""",
    "appointment_statuses": """select * from (values
      (1,'scheduled','Programada','#3B82F6'),(2,'confirmed','Confirmada','#10B981'),
      (3,'arrived','Paciente llegó','#F59E0B'),(4,'in_progress','En curso','#8B5CF6'),
      (5,'completed','Completada','#059669'),(6,'cancelled','Cancelada','#DC2626'),
      (7,'no_show','No asistió','#6B7280'),(8,'rescheduled','Reprogramada','#F97316')
      ) s(id,name,display_name,color)""",
    "users": """
      select c_custkey id,
        case c_custkey%10 when 0 then 'CE' when 1 then 'PASSPORT' else 'DNI' end document_type,
        lpad(cast(c_custkey as {str}),8,'0') document_number,
        concat('u',cast(c_custkey as {str}),'@x.pe') email,
        concat('P',cast(c_custkey%97 as {str})) first_name, c_name last_name,
        case when c_custkey%3=0 then concat('9',lpad(cast(c_custkey as {str}),8,'0')) end phone,
        c_custkey%5 role_id, true is_active,
        case when c_custkey%13=0 then null else timestamp '2024-01-01 08:00:00' end last_login,
        cast(c_custkey%12 as int) failed_login_attempts,
        case when c_custkey%4=0 then timestamp '2024-01-02 09:00:00' end last_failed_login,
        case when c_custkey%6=0 then timestamp '2024-01-03 10:00:00' end locked_until,
        concat('h',cast(c_custkey%1000 as {str})) password,
        cast(1+c_custkey%4 as int) jwt_version,
        concat('s',cast(c_custkey as {str})) session_id,
        cast(null as timestamp) password_changed_at
      from {customer}""",
    "users_new": """
      select c_custkey id,
        case c_custkey%10 when 0 then 'CE' when 1 then 'PASSPORT' else 'DNI' end document_type,
        lpad(cast(c_custkey as {str}),8,'0') document_number,
        concat(case when c_custkey%7=0 then 'v' else 'u' end,cast(c_custkey as {str}),'@x.pe') email,
        concat('P',cast(c_custkey%97 as {str})) first_name, c_name last_name,
        case when c_custkey%3=0 then concat('9',lpad(cast(c_custkey as {str}),8,'0')) end phone,
        case when c_custkey%11=0 then (c_custkey+1)%5 else c_custkey%5 end role_id,
        c_custkey%17<>0 is_active,
        case when c_custkey%3=0 then timestamp '2024-01-15 08:00:00'
             when c_custkey%13=0 then null else timestamp '2024-01-01 08:00:00' end last_login,
        cast(c_custkey%12 as int) failed_login_attempts,
        case when c_custkey%4=0 then timestamp '2024-01-02 09:00:00' end last_failed_login,
        case when c_custkey%6=0 then timestamp '2024-01-03 10:00:00' end locked_until,
        case when c_custkey%19=0 then 'fresh' else concat('h',cast(c_custkey%1000 as {str})) end password,
        cast(1+c_custkey%4 as int) jwt_version,
        concat('s',cast(c_custkey as {str})) session_id,
        cast(null as timestamp) password_changed_at
      from {customer}""",
    "invoices": """
      select o_orderkey id, case when o_orderkey%2=0 then 'F001' else 'B001' end series,
        cast(null as {str}) correlative, o_custkey patient_id,
        cast(o_orderdate as date) issue_date,
        case when o_orderkey%3=0 then cast(o_orderdate as date) - 1 + cast(o_orderkey%4 as int) end due_date,
        o_orderstatus
      from {orders}""",
    # Invoices of many series, of which some bring a number of their own.
    "invoices_supplied": """
      select o_orderkey id,
        concat(case when o_orderkey%2=0 then 'F' else 'B' end,
               lpad(cast(o_custkey%60 as {str}),3,'0')) series,
        case when o_orderkey%3=0 then cast(1+o_orderkey%5 as {str}) end correlative,
        o_custkey patient_id, cast(o_orderdate as date) issue_date
      from {orders}""",
    "invoice_details": """
      select l.l_orderkey invoice_id, l.l_linenumber line_no, l.l_partkey service_id,
        l.l_suppkey supplier_id, cast(l.l_quantity as int) quantity,
        cast(p.p_retailprice as decimal(8,2)) unit_price,
        cast(l.l_discount*100 as decimal(5,2)) discount_percentage,
        cast(l.l_tax*100 as decimal(5,2)) tax_percentage
      from {lineitem} l join {part} p on l.l_partkey=p.p_partkey""",
    "inventory_categories": """
      select distinct cast(substr(p_brand,7) as bigint) id, p_brand name,
        upper(replace(p_brand,'#','-')) category_code,
        case when cast(substr(p_brand,7) as bigint)>1
          then cast(floor(cast(substr(p_brand,7) as bigint)/2) as bigint) end parent_id,
        cast(1+cast(substr(p_brand,7) as bigint)%6 as int) level
      from {part}""",
    "inventory_items": """
      select p_partkey id, concat('IT-',cast(p_partkey as {str})) code, p_name name,
        cast(substr(p_brand,7) as bigint) category_id, 'piece' unit_of_measure,
        cast(p_size as decimal(10,2)) minimum_stock,
        cast(case when p_partkey%4=0 then p_size+30 end as decimal(10,2)) maximum_stock,
        cast(case when p_partkey%5=0 then 0 else (p_partkey*13)%80 end as decimal(10,2)) current_stock,
        cast(p_partkey%3 as decimal(10,2)) reserved_stock,
        cast(p_retailprice as decimal(10,2)) unit_cost,
        cast(null as decimal(10,2)) last_purchase_cost,
        concat('S-',cast(p_partkey%100 as {str})) primary_supplier,
        concat('E-',cast(p_partkey%9 as {str})) location,
        p_partkey%3<>0 has_expiration,
        date '2024-01-15' + cast(p_partkey%70-20 as int) expiration_date,
        case when p_partkey%4<>0 then cast(10+p_partkey%40 as int) end expiration_alert_days,
        p_partkey%11<>0 is_active, timestamp '2023-06-01 00:00:00' created_at
      from {part}""",
    "inventory_movements": """
      select l_partkey item_id, l_orderkey order_no, l_linenumber line_no, l_suppkey supplier_id,
        cast(l_shipdate as timestamp) created_at,
        case l_returnflag when 'A' then 'purchase'
          when 'R' then case l_linenumber when 4 then 'adjustment' else 'return' end
          else case l_linenumber when 1 then 'waste' when 2 then 'transfer' when 3 then 'expired'
               else 'consumption' end end movement_type,
        cast(case when l_returnflag='N' or (l_returnflag='R' and l_linenumber=4 and l_suppkey%2=0)
          then -l_quantity else l_quantity end as decimal(10,2)) quantity,
        case when l_returnflag='A' or (l_returnflag='R' and l_suppkey%4<>0) then
          cast(cast((l_partkey*7+l_suppkey*13+l_linenumber*101)%5000+50 as decimal(12,2))*0.01
            as decimal(10,2)) end unit_cost,
        concat('LT-',cast(l_suppkey as {str})) batch_number
      from {lineitem}""",
    # Movement rows that state the stock before and after, not always rightly.
    "movement_claims": """
      select item_id, order_no, line_no, supplier_id, created_at, movement_type,
        case movement_type when 'adjustment' then 'adjustment'
          when 'purchase' then 'in' when 'return' then 'in' else 'out' end movement_category,
        quantity,
        cast(base+60*was as decimal(10,2)) previous_stock,
        cast(case when line_no=7 and supplier_id%3=0 then -5
          when line_no=6 and supplier_id%5=0 then base+60*was+quantity+1
          else base+60*was+quantity end as decimal(10,2)) new_stock,
        case when movement_type='purchase' or (movement_type='return' and supplier_id%4<>0) then
          cast(cast((item_id*7+supplier_id*13+line_no*101)%5000+50 as decimal(12,2))*0.01
            as decimal(10,2)) end unit_cost,
        false approval_required, true is_approved
      from (
        select item_id, order_no, line_no, supplier_id, created_at, base, was,
          case when becomes>was then case when line_no%2=0 then 'purchase' else 'return' end
               when becomes<was then case when line_no%2=0 then 'waste' else 'consumption' end
               else 'adjustment' end movement_type,
          cast(60*(becomes-was) as decimal(10,2)) quantity
        from (
          select l_partkey item_id, l_orderkey order_no, l_linenumber line_no,
            l_suppkey supplier_id, cast(l_shipdate as timestamp) created_at,
            case when l_partkey%5=0 then 0 else (l_partkey*13)%80 end base,
            (l_orderkey+l_linenumber)%3 was, (l_suppkey+l_orderkey*2)%3 becomes
          from {lineitem}) m) c""",
    "inventory_batches": """
      select l_partkey*1000000+l_suppkey id, l_partkey item_id,
        concat('LT-',cast(l_suppkey as {str})) batch_number,
        cast(sum(l_quantity) as decimal(10,2)) quantity_received,
        cast(case when (l_partkey+l_suppkey)%6=0 then 0 else sum(l_quantity) end as decimal(10,2)) quantity_current,
        cast(max(l_shipdate) as date) expiration_date, cast(min(l_shipdate) as date) purchase_date,
        true is_active
      from {lineitem} group by l_partkey, l_suppkey""",
    "inventory_alerts": """
      select id, item_id, alert_type,
        case n%3 when 0 then 'info' when 1 then 'warning' else 'critical' end alert_level,
        concat('Alerta ',cast(id as {str})) title, concat('Aviso ',cast(n as {str})) message,
        cast(n as decimal(10,2)) threshold_value, cast(q as decimal(10,2)) current_value,
        cast(null as date) expiration_date, cast(null as {str}) batch_number,
        n%2=0 is_read, n%4=0 is_resolved,
        case when n%4=0 then cast(date '2024-01-15' - cast(n as int) as timestamp) end resolved_at,
        case when n%4=0 then cast(date '2024-01-15' - cast(q*7%60 as int) as timestamp) end auto_resolve_date,
        cast(date '2023-12-01' + cast(q%30 as int) as timestamp) created_at,
        cast(null as timestamp) updated_at
      from (
        select l_partkey*3 + case l_returnflag when 'A' then 0 when 'R' then 1 else 2 end id,
          l_partkey item_id,
          case l_returnflag when 'A' then 'low_stock' when 'R' then 'expiring_soon' else 'expired' end alert_type,
          count(*) n, cast(sum(l_quantity) as bigint) q
        from {lineitem} group by l_partkey, l_returnflag) g""",
    "medical_records": """
      select doc_id id, doc_id%1500 patient_id, doc_id%20 dentist_id,
        date '2024-01-16' - cast(doc_id%400 as int) visit_date,
        date '2024-01-20' - cast(doc_id%407 as int) next_visit_date,
        cast(null as {str}) record_number
      from {documents}""",
    "prescriptions": """
      select doc_id id, doc_id%1500 patient_id, doc_id%20 dentist_id,
        date '2024-01-16' - cast(doc_id%300 as int) prescription_date,
        case when doc_id%9=0 then '[1' else concat('[',cast(quality as {str}),']') end medications,
        cast(null as {str}) prescription_number
      from {labels}""",
    "laboratory_orders": """
      select page_id id, page_id%1500 patient_id, page_id%20 dentist_id,
        date '2024-01-16' - cast(page_id%200 as int) order_date,
        concat('["',url,'"]') tests_requested, cast(null as {str}) order_number
      from {pages}""",
    # Columns that only checks look at, beside the projections above.
    "invoice_references": """
      select o_orderkey id, case when o_orderkey%4<>0 then o_orderkey%5 end payment_method_id,
        case o_orderkey%6 when 0 then null when 1 then 'é' when 2 then '12' else concat('OP-',cast(o_orderkey as {str})) end
          payment_reference
      from {orders}""",
    "user_limits": """
      select c_custkey id, cast(c_custkey%60 as int) lockout_count,
        date '2024-01-25' - cast(c_custkey*37 as int) birth_date
      from {customer}""",
    "category_places": """
      select distinct cast(substr(p_brand,7) as bigint) id, cast(substr(p_brand,7) as bigint)%5-1 sort_order
      from {part}""",
    "movement_approvals": """
      select l_orderkey id, l_linenumber%2=0 approval_required, l_linenumber%3=0 is_approved,
        case when l_partkey%2=0 then l_suppkey end approved_by
      from {lineitem}""",
    "appointment_unavailabilities": """
      select event_id id, cast(ts as date) start_date, cast(ts as date) + cast(event_id%6-1 as int) end_date,
        case when event_id%4<>0 then cast(28800+event_id%7*3600 as int) end start_time,
        case when event_id%5<>0 then cast(36000+event_id%11*1800 as int) end end_time
      from {events}""",
    "appointment_reminders": """
      select event_id id, cast(event_id%8 as int) retry_count, cast(event_id%180 as int) hours_before
      from {events}""",
    "services": """
      select p_partkey id, cast(p_retailprice-1000 as decimal(10,2)) price, cast(p_size*11 as int) duration_minutes
      from {part}""",
    "invoice_payments": """
      select o_orderkey id, cast(o_orderkey%40-1 as decimal(10,2)) amount from {orders}""",
    "treatment_types": """
      select p_partkey id, cast(p_size*10 as int) estimated_duration, cast(p_partkey%30-1 as decimal(10,2)) base_price
      from {part}""",
    "treatment_records": """
      select l_orderkey*10+l_linenumber id, cast(l_suppkey%25-1 as decimal(10,2)) final_price,
        case when l_linenumber%3<>0 then cast(l_partkey%100 as {str}) end tooth_number
      from {lineitem}""",
    "medical_record_files": """
      select doc_id id, doc_id%50-1 file_size,
        case doc_id%5 when 0 then 'IMAGE/PNG ' when 1 then 'application/pdf' when 2 then 'text/html' else 'image/jpeg' end file_type
      from {documents}""",
    "notifications": "select event_id id, cast(event_id%9 as int) retry_count from {events}",
    "support_tickets": """
      select doc_id id, concat('TK-',cast(case when doc_id%17=0 then doc_id-doc_id%34 else doc_id end as {str})) ticket_number,
        doc_id%1500 user_id, text title,
        case doc_id%6 when 0 then 'Technical ' when 1 then 'question' else 'billing' end category,
        case when doc_id%9=0 then 'urgent' else 'low' end priority,
        case when doc_id%23<>0 then 'open' end status,
        cast(doc_id%120 as decimal(8,2)) estimated_hours
      from {documents}""",
    "support_ticket_messages": """
      select conv_id*1000+turn id, case turn%4 when 0 then '[1' when 1 then null else concat('[',cast(turn as {str}),']') end attachments
      from {conversations}""",
    "system_maintenance": """
      select s_suppkey id, timestamp '2024-01-10 00:00:00' starts_at,
        cast(date '2024-01-08' + cast(s_suppkey%9 as int) as timestamp) ends_at,
        case when s_suppkey%6=0 then 'all' else '["billing"]' end affected_modules
      from {supplier}""",
    "user_profiles": """
      select c_custkey id, cast(c_custkey%80 as int) years_experience, cast(c_acctbal as decimal(12,2)) salary
      from {customer}""",
    # Wider projections, for the declarations that look at whole rows, keys and references.
    "unavailability_rows": """
      select event_id id, case when event_id%53<>0 then user_id%20 end dentist_id, cast(ts as date) start_date,
        cast(ts as date) + cast(event_id%6 as int) end_date, case when event_id%31<>0 then event_type end reason,
        case event_id%6 when 0 then 'Personal ' when 1 then 'holiday' else 'training' end type,
        user_id created_by, case when event_id%3=0 then user_id+1 end approved_by
      from {events}""",
    "reminder_rows": """
      select event_id id, event_id+event_id%3 appointment_id,
        case event_id%5 when 0 then 'fax' else 'email' end reminder_type,
        case when event_id%29<>0 then cast(ts as timestamp) end send_at, cast(event_id%180 as int) hours_before
      from {events}""",
    "service_rows": """
      select p_partkey id, concat('SV-',cast(p_partkey-(p_partkey%40)%2 as {str})) code, p_name name, p_type category,
        cast(p_retailprice-1000 as decimal(10,2)) price, cast(p_size*11 as int) duration_minutes
      from {part}""",
    "treatment_type_rows": """
      select p_partkey id, concat(case when p_partkey%2=0 then 'TT-' else 'tt-' end,cast(cast(floor(p_partkey/2) as bigint) as {str})) code,
        p_name name, p_type category, cast(p_size*10 as int) estimated_duration,
        cast(p_partkey%30-1 as decimal(10,2)) base_price
      from {part}""",
    "payment_rows": """
      select o_orderkey id, case when o_orderkey%13=0 then -1 else o_orderkey end invoice_id,
        o_orderkey%9 payment_method_id, cast(o_orderkey%40-1 as decimal(10,2)) amount,
        case when o_orderkey%37<>0 then cast(o_orderdate as date) end payment_date, o_custkey processed_by
      from {orders}""",
    "treatment_rows": """
      select l_orderkey*10+l_linenumber id, l_orderkey%3000 medical_record_id, l_partkey+l_linenumber treatment_type_id,
        concat(case when l_linenumber=7 then 'tooth ' else '' end,cast(l_partkey%100 as {str})) tooth_number,
        cast(l_suppkey%25-1 as decimal(10,2)) final_price,
        case l_returnflag when 'A' then 'planned' when 'R' then 'COMPLETED' else 'open' end status
      from {lineitem}""",
    "file_rows": """
      select doc_id id, doc_id+doc_id%4 medical_record_id, source file_name, text file_path,
        'application/pdf' file_type, doc_id%50 file_size, doc_id%1500 uploaded_by
      from {documents}""",
    "notification_rows": """
      select event_id id, user_id, event_type title, case when event_id%43<>0 then props end message,
        case event_id%4 when 0 then 'notice' else 'info' end type, 'email' method, cast(event_id%300 as int) retry_count
      from {events}""",
    "message_rows": """
      select conv_id*1000+turn id, conv_id ticket_id, turn user_id, text message from {conversations}""",
    "maintenance_rows": """
      select s_suppkey id, s_name title, case s_suppkey%3 when 0 then 'Update' when 1 then 'scheduled' else 'repair' end
        maintenance_type, timestamp '2024-01-10 00:00:00' starts_at, s_suppkey*2 created_by
      from {supplier}""",
    "profile_rows": """
      select c_custkey id, c_custkey-c_custkey%2 user_id, cast(c_custkey%400 as int) years_experience,
        cast(c_acctbal*200 as decimal(12,2)) salary, c_name department
      from {customer}""",
    "login_rows": """
      select event_id id, concat('u',cast(user_id as {str}),'@x.pe') email,
        case when event_id%17<>0 then concat('10.0.0.',cast(event_id%256 as {str})) end ip_address,
        event_id%3=0 is_successful, props failure_reason
      from {events}""",
    "reset_rows": """
      select event_id id, case when event_id%19<>0 then concat('u',cast(user_id as {str}),'@x.pe') end email, props token,
        cast(ts as timestamp) expires_at
      from {events}""",
    "method_rows": """
      select n_nationkey id, concat('M-',cast(n_nationkey%20 as {str})) code, n_name name,
        case n_nationkey%3 when 0 then 'Cash' when 1 then 'cheque' else 'card' end type
      from {nation} where n_nationkey<>7""",
    "holiday_rows": """
      select n_nationkey id, case when n_nationkey%5=0 then 'FERIADO' when n_nationkey%7<>0 then n_name end name,
        date '2024-12-20' + cast(n_nationkey as int) date, n_nationkey%2=0 is_recurring
      from {nation}""",
    "role_rows": "select r_regionkey id, case when r_regionkey=3 then 'ASIA' else r_name end name from {region}",
    "permission_rows": """
      select n_nationkey id, n_name name, n_name display_name, concat('m',cast(n_regionkey as {str})) module,
        concat('a',cast(n_nationkey%3 as {str})) action
      from {nation}""",
    "grant_rows": """
      select n_nationkey id, case when n_nationkey%4=0 then n_regionkey+2 else n_regionkey end role_id,
        case when n_nationkey%5=0 then 100 else n_nationkey-n_nationkey%2 end permission_id
      from {nation}""",
    "configuration_rows": """
      select s_suppkey id, case when s_suppkey%9<>0 then 'general' end category, concat('key ',cast(s_nationkey as {str})) key_name,
        case when s_suppkey%2=0 then 'string' else 'text' end data_type, s_suppkey*3 last_modified_by
      from {supplier}""",
    "line_rows": """
      select l_orderkey id, l_orderkey+case when l_linenumber=5 then 100000000 else 0 end invoice_id, l_partkey service_id,
        cast(l_quantity as int) quantity, cast(l_discount*100 as decimal(5,2)) discount_percentage
      from {lineitem}""",
    "movement_rows": """
      select l_orderkey id, l_partkey item_id, l_suppkey user_id, case when l_linenumber=2 then l_suppkey+5 end approved_by,
        case l_returnflag when 'A' then 'Purchase' when 'R' then 'theft' else 'return' end movement_type,
        cast(l_quantity*4000000 as decimal(12,2)) quantity
      from {lineitem}""",
    "audit_logs": """
      select event_id id, case when event_id%8=0 then null else user_id end user_id,
        event_type action, 'users' table_name, user_id record_id,
        case when event_id%37=0 then substr(props,2) else props end old_values,
        case when event_id%41=0 then null else props end new_values,
        case event_id%5 when 0 then 'low' when 1 then 'HIGH ' when 2 then 'severe' else 'medium' end risk_level,
        cast(ts as timestamp) created_at
      from {events}""",
}


# A projection for each declared table, the widest there is.
PROJECTIONS: dict[str, str] = {
    "appointments": "asked_visits", "appointment_unavailabilities": "unavailability_rows",
    "appointment_reminders": "reminder_rows", "services": "service_rows", "treatment_types": "treatment_type_rows",
    "invoice_payments": "payment_rows", "treatment_records": "treatment_rows", "medical_record_files": "file_rows",
    "notifications": "notification_rows", "support_ticket_messages": "message_rows",
    "system_maintenance": "maintenance_rows", "user_profiles": "profile_rows", "login_attempts": "login_rows",
    "password_resets": "reset_rows", "payment_methods": "method_rows", "roles": "role_rows",
    "permissions": "permission_rows", "holidays": "holiday_rows", "role_permissions": "grant_rows", "system_configurations": "configuration_rows",
    "invoice_details": "line_rows", "inventory_movements": "movement_rows",
    **{
        t: t for t in (
            "appointment_statuses", "working_hours", "invoices", "inventory_categories", "inventory_items",
            "inventory_batches", "inventory_alerts", "medical_records", "prescriptions", "laboratory_orders",
            "audit_logs", "support_tickets", "users",
        )
    },
}


def sql(table: str, **names: str) -> str:
    """The projection with engine-specific names put in."""
    text = TABLES[table]
    if "{visit}" in text:
        text = text.replace("{visit}", _VISIT).replace("{code}", _CODE)
    return text.format(**names)


SOURCES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

DUCKDB_NAMES = {
    "str": "varchar", "days": "unnest([1,2,3,4,5])", **{s: s for s in SOURCES},
}


def read(spark: SparkSession, sf_dir: str, table: str, stream: bool = False) -> DataFrame:
    """One clinic table, with the columns it derives from its own row.

    With `stream` the source files are read as a stream.
    """
    used = [s for s in SOURCES if "{" + s + "}" in TABLES[table]]
    text = sql(
        table, str="string", days="explode(array(1,2,3,4,5))", **{s: "{" + s + "}" for s in used}
    )
    frames = {}
    for source in used:
        path = f"{sf_dir}/{source}.parquet"
        frames[source] = spark.read.parquet(path)
        if stream:
            # A pattern, because the stream reader takes a single file in no other way.
            files = f"{sf_dir}/{source}[.]parquet"
            reader = spark.readStream.schema(frames[source].schema)
            # No limit for a trigger: what is there is one ordered batch, however it is cut into files.
            frames[source] = reader.parquet(files)
    visits = ("bookings", "requests", "late_bookings", "coded_requests", "asked_visits", "appointment_proposals")
    kind = "appointments" if table in visits else "holidays" if table == "holiday_rows" else table
    return generated(kind, spark.sql(text, **frames))
