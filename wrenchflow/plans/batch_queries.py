"""Registered queries of batches and what they leave behind: table versions, new vehicles, row access.

The oracles of table versions read the oracle of the batch (``applied``) and merge
its accepted changes into the bound tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from wrenchflow.functions.exprs import coerce_number
from wrenchflow.operators import access as A
from wrenchflow.operators import after as V
from wrenchflow.operators import changes as M
from wrenchflow.operators import intervals as IV
from wrenchflow.operators import listing as L
from wrenchflow.operators import metrics
from wrenchflow.operators import vehicles as W
from wrenchflow.plans import queries as Q
from wrenchflow.plans import standins as SI
from wrenchflow.plans.catalog import REGISTRY, register
from wrenchflow.sources.binding import AS_OF

BIG = SI.BIG
BOOKING = ["id", "customer_id", "mechanic_id", "vehicle_id", "booking_date", "start_min", "status", "notes", "total_price", "completed_at"]


def _after(name: str, select: str) -> str:
    return f"WITH applied AS ({REGISTRY[name].sql})\n{select}"


def _bookings(mechanic: str = "b.mechanic_id", status: str = "b.status", notes: str = "b.notes", done: str = "b.completed_at",
              more: str = "") -> str:
    return f"""SELECT b.id, b.customer_id, {mechanic} AS mechanic_id, b.vehicle_id, CAST(b.booking_date AS VARCHAR) AS booking_date, b.start_min,
  {status} AS status, {notes} AS notes, CAST(b.total_price AS DOUBLE) AS total_price,
  strftime({done}, '%Y-%m-%d %H:%M:%S') AS completed_at FROM bookings b {more}"""


# ---------------------------------------------------------------- table versions

@register("bookings_after_new_bookings", _after("apply_new_bookings", _bookings() + """
UNION ALL SELECT id, customer_id, mechanic_id, vehicle_id, booking_date, start_min, 'pending', notes, total_price, NULL
FROM applied WHERE reject_reason IS NULL"""))
def q_bookings_after_new_bookings(g):
    """M1: the bookings with the accepted new ones."""
    return V.merged(g, V.after_new_bookings(g, Q.q_apply_new_bookings(g), AS_OF)).bookings.select(*BOOKING)


@register("payments_after_new_bookings", _after("apply_new_bookings", f"""
SELECT id, booking_id, payment_method, is_down_payment, down_payment_percent, CAST(down_payment_amount AS DOUBLE) AS down_payment_amount,
  payment_status FROM payments
UNION ALL SELECT (SELECT max(id) FROM payments) + row_number() OVER (ORDER BY id), id, payment_method, is_down_payment, down_payment_percent,
  down_payment_amount, 'pending' FROM applied WHERE reject_reason IS NULL AND payment_method IS NOT NULL"""))
def q_payments_after_new_bookings(g):
    """M1: the payments with a pending one for each new booking, under its key."""
    return V.merged(g, V.after_new_bookings(g, Q.q_apply_new_bookings(g), AS_OF)).payments.select(
        "id", "booking_id", "payment_method", "is_down_payment", "down_payment_percent", "down_payment_amount", "payment_status")


@register("vehicles_after_new_bookings", _after("apply_new_bookings", """, own AS (
  SELECT vehicle_id, arg_max(vehicle_owner_after, request_seq) AS owner FROM applied WHERE vehicle_owner_after IS NOT NULL GROUP BY 1)
SELECT v.id, coalesce(o.owner, v.customer_id) AS customer_id, v.license_plate FROM vehicles v LEFT JOIN own o ON v.id = o.vehicle_id"""))
def q_vehicles_after_new_bookings(g):
    """M1: the vehicles with the owners that bookings gave them (adopted, or reassigned by staff)."""
    return V.merged(g, V.after_new_bookings(g, Q.q_apply_new_bookings(g), AS_OF)).vehicles.select("id", "customer_id", "license_plate")


@register("customers_after_new_bookings", _after("apply_new_bookings", """
SELECT c.id, c.user_id, CASE WHEN n.k IS NULL THEN c.total_bookings ELSE coalesce(c.total_bookings, 0) + n.k END AS total_bookings
FROM customers c LEFT JOIN (SELECT customer_id, count(*) AS k FROM applied WHERE reject_reason IS NULL GROUP BY 1) n ON n.customer_id = c.id"""))
def q_customers_after_new_bookings(g):
    """M1: the customers with their counters of bookings."""
    return V.merged(g, V.after_new_bookings(g, Q.q_apply_new_bookings(g), AS_OF)).customers.select("id", "user_id", "total_bookings")


@register("bookings_after_cancellations", _after("apply_cancellations", _bookings(
    status="CASE WHEN b.id IN (SELECT booking_id FROM applied WHERE reject_reason IS NULL) THEN 'cancelled' ELSE b.status END")))
def q_bookings_after_cancellations(g):
    """M3: the bookings with the accepted cancellations."""
    return V.merged(g, V.after_cancellations(g, Q.q_apply_cancellations(g))).bookings.select(*BOOKING)


@register("bookings_after_assignments", _after("assign_mechanics", """, l AS (
  SELECT booking_id, arg_max(mechanic_id, request_seq) AS mechanic FROM applied WHERE reject_reason IS NULL GROUP BY 1)
""" + _bookings("coalesce(l.mechanic, b.mechanic_id)", "CASE WHEN l.mechanic IS NOT NULL THEN 'confirmed' ELSE b.status END",
                more="LEFT JOIN l ON b.id = l.booking_id")))
def q_bookings_after_assignments(g):
    """M4: the bookings with their new mechanics."""
    return V.merged(g, V.after_assignments(g, Q.q_assign_mechanics(g))).bookings.select(*BOOKING)


@register("tasks_after_assignments", _after("assign_mechanics", """
SELECT id, booking_id, mechanic_id, status, start_min, end_min FROM mechanic_tasks
UNION ALL SELECT (SELECT max(id) FROM mechanic_tasks) + row_number() OVER (ORDER BY request_seq, booking_id, mechanic_id),
  booking_id, mechanic_id, 'pending', start_min, end_min FROM applied WHERE reject_reason IS NULL"""))
def q_tasks_after_assignments(g):
    """M4: the tasks with one for each accepted assignment."""
    return V.merged(g, V.after_assignments(g, Q.q_assign_mechanics(g))).mechanic_tasks


_TASK_KEY = "coalesce(CAST(task_id AS VARCHAR), concat(booking_id, ' ', CAST(mechanic_id AS VARCHAR)))"


@register("tasks_after_status_changes", _after("apply_task_status", f""", l AS (
  SELECT * FROM applied WHERE reject_reason IS NULL
  QUALIFY row_number() OVER (PARTITION BY {_TASK_KEY} ORDER BY change_seq DESC, ref DESC) = 1)
SELECT t.id, t.booking_id, t.mechanic_id, coalesce(l.status, t.status) AS status,
  CASE WHEN l.status IS NULL THEN t.start_min ELSE l.start_min END AS start_min, CASE WHEN l.status IS NULL THEN t.end_min ELSE l.end_min END AS end_min
FROM mechanic_tasks t LEFT JOIN l ON l.task_id = t.id
UNION ALL SELECT (SELECT max(id) FROM mechanic_tasks) + row_number() OVER (ORDER BY booking_id, mechanic_id), booking_id, mechanic_id, status,
  start_min, end_min FROM l WHERE task_id IS NULL"""))
def q_tasks_after_status_changes(g):
    """M5: the tasks after all status changes, with those that were created."""
    applied = M.apply_task_status(g, SI.task_status_changes(g))
    return V.merged(g, V.after_task_status(g, applied)).mechanic_tasks


@register("bookings_after_task_status", _after("apply_task_status", """, l AS (
  SELECT booking_id, arg_max(booking_status, change_seq) AS status FROM applied WHERE booking_status IS NOT NULL GROUP BY 1),
d AS (SELECT booking_id, arg_max(completed_min, change_seq) AS done FROM applied WHERE completed_min IS NOT NULL GROUP BY 1)
""" + _bookings(status="coalesce(l.status, b.status)",
                done="coalesce(CAST(b.booking_date AS TIMESTAMP) + INTERVAL 1 MINUTE * d.done, b.completed_at)",
                more="LEFT JOIN l ON b.id = l.booking_id LEFT JOIN d ON b.id = d.booking_id")))
def q_bookings_after_task_status(g):
    """M5: the bookings that mirror their tasks."""
    applied = M.apply_task_status(g, SI.task_status_changes(g))
    return V.merged(g, V.after_task_status(g, applied)).bookings.select(*BOOKING)


@register("payments_after_decisions", _after("apply_payment_decisions", """
SELECT p.id, p.booking_id, coalesce(a.new_payment_status, p.payment_status) AS payment_status, coalesce(a.admin_notes, p.admin_notes) AS admin_notes
FROM payments p LEFT JOIN applied a ON a.payment_id = p.id AND a.is_final"""))
def q_payments_after_decisions(g):
    """M6: the payments after all decisions."""
    return V.merged(g, V.after_payment_decisions(g, Q.q_apply_payment_decisions(g))).payments.select(
        "id", "booking_id", "payment_status", "admin_notes")


@register("bookings_after_decisions", _after("apply_payment_decisions", _bookings(
    status="CASE WHEN b.id IN (SELECT booking_id FROM applied WHERE booking_status IS NOT NULL) THEN 'confirmed' ELSE b.status END")))
def q_bookings_after_decisions(g):
    """M6: the bookings of approved payments confirmed."""
    return V.merged(g, V.after_payment_decisions(g, Q.q_apply_payment_decisions(g))).bookings.select(*BOOKING)


@register("testimonials_after_moderation", _after("moderate_testimonials", """, l AS (
  SELECT testimonial_id, arg_max(approved_after, action_seq) AS a, arg_max(featured_after, action_seq) AS f
  FROM applied WHERE reject_reason IS NULL GROUP BY 1)
SELECT t.id, t.rating, coalesce(l.a, t.approved) AS approved, coalesce(l.f, t.featured) AS featured
FROM testimonials t LEFT JOIN l ON t.id = l.testimonial_id"""))
def q_testimonials_after_moderation(g):
    """M8: the testimonials after all moderation."""
    return V.merged(g, V.after_moderation(g, Q.q_moderate_testimonials(g))).testimonials.select("id", "rating", "approved", "featured")


@register("notes_after_appends", _after("append_field_notes", """
SELECT id, booking_id, mechanic_id, note, CAST(date AS VARCHAR) AS date, status FROM field_notes
UNION ALL SELECT (SELECT max(id) FROM field_notes) + row_number() OVER (ORDER BY note_seq, booking_id), booking_id, mechanic_id, note, date, status
FROM applied WHERE reject_reason IS NULL"""))
def q_notes_after_appends(g):
    """The field notes with the accepted new ones."""
    return V.merged(g, V.after_field_notes(g, Q.q_append_field_notes(g))).field_notes.select(
        "id", "booking_id", "mechanic_id", "note", "date", "status")


@register("bookings_after_notes", _after("append_field_notes", """, l AS (
  SELECT DISTINCT booking_id, booking_note_after AS n FROM applied WHERE reject_reason IS NULL)
""" + _bookings(notes="coalesce(l.n, b.notes)", more="LEFT JOIN l ON b.id = l.booking_id")))
def q_bookings_after_notes(g):
    """The bookings with their newest note."""
    return V.merged(g, V.after_field_notes(g, Q.q_append_field_notes(g))).bookings.select(*BOOKING)


@register("users_after_provisioning", _after("provision_users", """
SELECT id, name, email, role, status FROM users
UNION ALL SELECT user_id, name, email, role, 'active' FROM applied WHERE reject_reason IS NULL"""))
def q_users_after_provisioning(g):
    """The users with the new accounts."""
    return V.merged(g, V.after_provisioning(g, Q.q_provision_users(g))).users


@register("role_rows_after_provisioning", _after("provision_users", """
SELECT 'customer' AS role, id, user_id, address AS detail FROM customers
UNION ALL SELECT 'customer', (SELECT max(id) FROM customers) + row_number() OVER (ORDER BY user_id), user_id, address
FROM applied WHERE reject_reason IS NULL AND role = 'customer'
UNION ALL SELECT 'mechanic', id, user_id, specialization FROM mechanics
UNION ALL SELECT 'mechanic', (SELECT max(id) FROM mechanics) + row_number() OVER (ORDER BY user_id), user_id, specialization
FROM applied WHERE reject_reason IS NULL AND role = 'mechanic'"""))
def q_role_rows_after_provisioning(g):
    """Customers and mechanics with a row for every new account, under its user id."""
    new = V.merged(g, V.after_provisioning(g, Q.q_provision_users(g)))
    return new.customers.select(F.lit("customer").alias("role"), "id", "user_id", F.col("address").alias("detail")).unionByName(
        new.mechanics.select(F.lit("mechanic").alias("role"), "id", "user_id", F.col("specialization").alias("detail")))


# ---------------------------------------------------------------- unique plates and VINs

def _vehicles_sql() -> str:
    """The requests step by step: within a step only the shared plate repeats, and its first request wins."""
    plates = ["concat('B ', id)", "concat('N ', id)", "concat('N ', id)", "concat('M ', id)", "concat('K ', id)", "'TEMP'",
              "concat('H ', id)", "concat('S ', id)", "concat('F ', id)", "concat('K ', id)"]
    vins = ["NULL", "concat('W', id)", "concat('X', id)", "concat('X', id)", "concat('W', id)", "concat('H', id)", "concat('H', id)",
            "concat('VIN', id)", "''", "NULL"]
    ctes, step = [], 0
    for k, (plate, vin) in enumerate(zip(plates, vins)):
        role = {8: "CASE id % 3 WHEN 0 THEN 'mechanic' WHEN 1 THEN 'staff' ELSE 'customer' END", 9: "'staff'"}.get(k, "'customer'")
        cust = {8: "CASE WHEN id % 3 = 2 THEN customer_id END"}.get(k, "customer_id")
        make = "CASE WHEN id % 6 <> 2 THEN make END" if k == 8 else "make"
        earlier = f"SELECT license_plate AS p, vin AS v FROM vehicles{''.join(f' UNION ALL SELECT license_plate, vin FROM ok{j}' for j in range(k))}"
        ctes.append(f"""r{k} AS (SELECT {k} * {BIG} + id AS request_seq, {role} AS role, {cust} AS customer_id, {make} AS make, model, year,
    {plate} AS license_plate, CAST({vin} AS VARCHAR) AS vin FROM vehicles),
taken{k} AS ({earlier}),
j{k} AS (SELECT r.*, CASE WHEN make IS NULL OR make = '' OR model IS NULL OR model = '' OR coalesce(year, 0) = 0
           THEN 'Make, model, year, and license plate are required'
         WHEN role = 'staff' AND coalesce(customer_id, 0) = 0 THEN 'Customer ID is required for admin/staff'
         WHEN role = 'mechanic' THEN 'Not authorized to create vehicles'
         WHEN license_plate IN (SELECT p FROM taken{k} WHERE p IS NOT NULL) THEN 'License plate is already registered'
         WHEN vin <> '' AND vin IN (SELECT v FROM taken{k} WHERE v IS NOT NULL) THEN 'VIN is already registered' END AS why FROM r{k} r),
s{k} AS (SELECT *, CASE WHEN why IS NULL AND row_number() OVER (PARTITION BY license_plate, why IS NULL ORDER BY request_seq) > 1
           THEN 'License plate is already registered' ELSE why END AS reject_reason FROM j{k}),
ok{k} AS (SELECT * FROM s{k} WHERE reject_reason IS NULL)""")
        step = k
    whole = " UNION ALL ".join(f"SELECT * FROM s{k}" for k in range(step + 1))
    return "WITH " + ",\n".join(ctes) + f""",
whole AS ({whole})
SELECT request_seq, customer_id, make, model, year, license_plate, vin, 'white' AS color, reject_reason,
  CASE WHEN reject_reason IS NULL THEN (SELECT max(id) FROM vehicles)
    + row_number() OVER (PARTITION BY reject_reason IS NULL ORDER BY request_seq) END AS id FROM whole"""


@register("apply_new_vehicles", _vehicles_sql())
def q_apply_new_vehicles(g):
    """Registrations of vehicles, unique by plate and by VIN; a refused one takes neither."""
    return W.apply_new_vehicles(g, SI.vehicle_requests(g))


@register("vehicles_after_registrations", _after("apply_new_vehicles", """
SELECT id, customer_id, license_plate, vin FROM vehicles
UNION ALL SELECT id, customer_id, license_plate, vin FROM applied WHERE reject_reason IS NULL"""))
def q_vehicles_after_registrations(g):
    """The vehicles with the accepted new ones."""
    return W.vehicles_after(g, W.apply_new_vehicles(g, SI.vehicle_requests(g))).select("id", "customer_id", "license_plate", "vin")


def _unique_sql(table: str, key: str) -> str:
    return f"""
SELECT x.id, x.{key}, EXISTS (SELECT 1 FROM {table} s WHERE s.{key} = x.{key} AND s.id <> x.id) AS taken_by_other,
  coalesce(n.k > 1, false) AS duplicate_in_batch
FROM {table} x LEFT JOIN (SELECT {key}, count(*) AS k FROM {table} GROUP BY 1) n ON x.{key} = n.{key}"""


@register("user_email_uniqueness", _unique_sql("users", "email"))
def q_user_email_uniqueness(g):
    """E-mails of users against those of other users."""
    return L.uniqueness_check(g.users, g.users, "email").select("id", "email", "taken_by_other", "duplicate_in_batch")


@register("vehicle_plate_uniqueness", _unique_sql("vehicles", "license_plate"))
def q_vehicle_plate_uniqueness(g):
    """Plates of vehicles against those of other vehicles."""
    return L.uniqueness_check(g.vehicles, g.vehicles, "license_plate").select("id", "license_plate", "taken_by_other", "duplicate_in_batch")


@register("vehicle_vin_uniqueness", _unique_sql("vehicles", "vin"))
def q_vehicle_vin_uniqueness(g):
    """VINs of vehicles, where they have one, against those of other vehicles."""
    return L.uniqueness_check(g.vehicles, g.vehicles, "vin").select("id", "vin", "taken_by_other", "duplicate_in_batch")


# ---------------------------------------------------------------- row access

_OFFICE_SQL = "UNION ALL SELECT id, role, NULL, 'all' FROM users WHERE role IN ('admin', 'staff')"
_OWN_SQL = """SELECT u.id AS user_id, u.role, x.id AS row_id, 'own' AS scope FROM users u JOIN customers c ON c.user_id = u.id
JOIN {table} x ON x.customer_id = c.id WHERE u.role = 'customer'"""


@register("visible_vehicles", _OWN_SQL.format(table="vehicles") + "\n" + _OFFICE_SQL)
def q_visible_vehicles(g):
    """Vehicles that each user may see."""
    return A.visible_rows(g, "vehicles")


@register("visible_field_notes", f"""
SELECT u.id AS user_id, u.role, n.id AS row_id, 'assigned' AS scope FROM users u JOIN mechanics m ON m.user_id = u.id
JOIN bookings b ON b.mechanic_id = m.id JOIN field_notes n ON n.booking_id = b.id WHERE u.role = 'mechanic'
UNION ALL SELECT u.id, u.role, n.id, 'author' FROM users u JOIN mechanics m ON m.user_id = u.id
JOIN field_notes n ON n.mechanic_id = m.id WHERE u.role = 'mechanic'
{_OFFICE_SQL}""")
def q_visible_field_notes(g):
    """Field notes that each user may see: of bookings assigned to a mechanic, and its own."""
    return A.visible_rows(g, "field_notes")


@register("visible_testimonials", f"""
{_OWN_SQL.format(table="testimonials")} AND NOT x.approved
UNION ALL SELECT NULL, NULL, id, 'public' FROM testimonials WHERE approved
{_OFFICE_SQL}""")
def q_visible_testimonials(g):
    """Testimonials that anyone may see (approved), and unapproved ones of each customer."""
    return A.visible_rows(g, "testimonials")


@register("visible_users", f"""
SELECT id AS user_id, role, id AS row_id, 'self' AS scope FROM users WHERE role IN ('mechanic', 'customer', 'owner')
{_OFFICE_SQL}""")
def q_visible_users(g):
    """Users that each user may see."""
    return A.visible_rows(g, "users")


# ---------------------------------------------------------------- other forms of registered operators

@register("revenue_by_day", f"""
SELECT strftime(booking_date, '%Y-%m-%d') AS period,
  CAST(coalesce(sum(total_price) FILTER (WHERE status = 'completed'), 0) AS DOUBLE) AS total_revenue,
  count(*) FILTER (WHERE status = 'completed') AS completed_bookings
FROM bookings WHERE {Q.IN_R} GROUP BY 1""")
def q_revenue_by_day(g):
    """Daily revenue over the report range."""
    return metrics.revenue_by_period(g, "daily", Q.R_START, Q.R_END)


def _report(kind: str, day: str, start: str, end: str) -> None:
    monthly = REGISTRY["generate_report"].sql

    @register(f"generate_report_{kind}", monthly.replace("'monthly'", f"'{kind}'").replace("'2000-06-15'", f"'{day}'")
              .replace(Q.M_START, start).replace(Q.M_END, end))
    def report(g):
        return metrics.generate_report(g, kind, day)
    REGISTRY[f"generate_report_{kind}"].doc = f"A19 + E7: {kind} report for {day}."


_report("daily", "2000-06-15", "2000-06-15", "2000-06-15")
_report("weekly", "2000-06-15", "2000-06-12", "2000-06-18")
_report("yearly", "2000-06-15", "2000-01-01", "2000-12-31")


def _insight(span: str, start: str, before: str, until: str) -> None:
    """The quarter's queries over another span: its start, and start and end of the span before."""
    def spans(sql: str) -> str:
        return (sql.replace(Q.P_END, "<until>").replace(Q.P_START, "<before>").replace(Q.I_START, "<start>")
                .replace("<until>", until).replace("<before>", before).replace("<start>", start))

    growth = f"""
SELECT count(*) FILTER (WHERE booking_date BETWEEN DATE '{start}' AND DATE '{AS_OF}') AS current_bookings,
  count(*) FILTER (WHERE booking_date BETWEEN DATE '{before}' AND DATE '{until}') AS previous_bookings,
  CAST(CASE WHEN previous_bookings > 0 THEN {Q.RHU0.format(x='(current_bookings - previous_bookings) * 100.0 / previous_bookings')}
       ELSE 0 END AS BIGINT) AS growth_rate FROM bookings"""

    @register(f"period_growth_{span}", growth)
    def grown(g):
        return metrics.period_growth(g, span, AS_OF)
    REGISTRY[f"period_growth_{span}"].doc = f"A20 + E8: bookings of the last {span} against the one before, growth %."

    @register(f"insight_top_service_{span}", spans(REGISTRY["insight_top_service"].sql))
    def service(g):
        return metrics.insight_top_service(g, span, AS_OF)
    REGISTRY[f"insight_top_service_{span}"].doc = f"A21 + E8: most booked service of the last {span}."


_insight("month", "2001-06-15", "2001-05-15", "2001-06-15")
_insight("year", "2000-07-15", "1999-07-15", "2000-07-15")


@register("apply_status_changes_by_staff", f"""
WITH ch AS (
  SELECT CAST(substr(id, 3) AS BIGINT) AS change_seq, id AS booking_id,
    CASE CAST(substr(id, 3) AS BIGINT) % 4 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'completed' WHEN 2 THEN 'washed' END AS new_status,
    CASE CAST(substr(id, 3) AS BIGINT) % 3 WHEN 0 THEN 'staff' WHEN 1 THEN 'admin' ELSE 'customer' END AS actor_role FROM bookings
  UNION ALL SELECT {BIG} + CAST(substr(id, 3) AS BIGINT), id, 'cancelled', 'staff' FROM bookings WHERE status = 'pending'),
c AS (SELECT ch.*, b.status AS old_status,
  CASE WHEN actor_role = 'customer' THEN 'Not authorized to update booking status'
       WHEN coalesce(new_status NOT IN ('pending', 'confirmed', 'in-progress', 'completed', 'cancelled'), true) THEN 'Valid status is required'
  END AS reject_reason FROM ch JOIN bookings b ON ch.booking_id = b.id),
l AS (SELECT booking_id, max(change_seq) AS last, bool_or(new_status = 'completed') AS done FROM c WHERE reject_reason IS NULL GROUP BY 1)
SELECT c.change_seq, c.booking_id, c.actor_role, CAST(NULL AS BIGINT) AS actor_mechanic_id, c.old_status, c.new_status, c.reject_reason,
  CASE WHEN c.reject_reason IS NULL AND (c.new_status = 'completed' OR (l.done AND l.last = c.change_seq)) THEN '{Q.M2_TS}' END AS completed_at,
  l.last IS NOT NULL AS is_final
FROM c LEFT JOIN l ON c.booking_id = l.booking_id AND c.change_seq = l.last""")
def q_apply_status_changes_by_staff(g):
    """M2: status changes by staff and admins (any of the five), refused for customers and for unknown statuses."""
    n = F.substring("id", 3, 40).cast("long")
    changes = g.bookings.select(
        n.alias("change_seq"), F.col("id").alias("booking_id"),
        F.when(n % 4 == 0, "confirmed").when(n % 4 == 1, "completed").when(n % 4 == 2, "washed").alias("new_status"),
        F.when(n % 3 == 0, "staff").when(n % 3 == 1, "admin").otherwise("customer").alias("actor_role"),
        F.lit(None).cast("long").alias("actor_mechanic_id"))
    again = g.bookings.where("status = 'pending'").select(
        (F.lit(BIG) + n).alias("change_seq"), F.col("id").alias("booking_id"), F.lit("cancelled").alias("new_status"),
        F.lit("staff").alias("actor_role"), F.lit(None).cast("long").alias("actor_mechanic_id"))
    return M.apply_status_changes(g, changes.unionByName(again), Q.M2_TS)


@register("bookings_keyset_page", """
SELECT id, CAST(booking_date AS VARCHAR) AS booking_date, status FROM bookings WHERE id > 'B-2' ORDER BY id LIMIT 40""")
def q_bookings_keyset_page(g):
    """L3: the page of 40 bookings that follows a key."""
    return L.keyset_page(g.bookings.select("id", "booking_date", "status"), "id", after="B-2", size=40)


@register("coerced_numbers", """
SELECT id, coalesce(TRY_CAST(license_plate AS DOUBLE), -1) AS plate_number, coalesce(TRY_CAST(replace(vin, 'VIN', '') AS DOUBLE), 0) AS vin_number
FROM vehicles""")
def q_coerced_numbers(g):
    """Numbers in text, with a default where there is none."""
    return g.vehicles.select("id", coerce_number("license_plate", -1).alias("plate_number"),
                             coerce_number(F.replace("vin", F.lit("VIN"), F.lit(""))).alias("vin_number"))


@register("partial_update_users", """
SELECT id, CASE WHEN role = 'mechanic' THEN upper(name) ELSE name END AS name, email, role,
  CASE WHEN role = 'mechanic' THEN 'on-leave' WHEN id % 3 = 0 THEN NULL ELSE status END AS status FROM users""")
def q_partial_update_users(g):
    """M9: users patched field by field; a later patch of a field wins, a supplied null is set."""
    m = g.users.where("role = 'mechanic'")
    text = F.lit(None).cast("string")
    first = m.select(F.lit(1).alias("patch_seq"), "id", F.lower("name").alias("name"), F.lit("on-leave").alias("status"),
                     F.array(F.lit("name"), F.lit("status")).alias("fields"))
    second = m.select(F.lit(2).alias("patch_seq"), "id", F.upper("name").alias("name"), text.alias("status"), F.array(F.lit("name")).alias("fields"))
    third = g.users.where("role <> 'mechanic' and id % 3 = 0").select(
        F.lit(3).alias("patch_seq"), "id", text.alias("name"), text.alias("status"), F.array(F.lit("status")).alias("fields"))
    return M.partial_update(g.users, first.unionByName(second).unionByName(third))


@register("partial_update_vehicles", """
SELECT id, customer_id, make, model, CASE WHEN customer_id IS NULL THEN year + 1 ELSE year END AS year, license_plate, vin,
  CASE WHEN customer_id IS NULL THEN 'red' ELSE color END AS color FROM vehicles""")
def q_partial_update_vehicles(g):
    """M9: vehicles without an owner repainted and corrected."""
    p = g.vehicles.where("customer_id is null").select(F.lit(1).alias("patch_seq"), "id", (F.col("year") + 1).alias("year"),
                                                       F.lit("red").alias("color"), F.array(F.lit("year"), F.lit("color")).alias("fields"))
    return M.partial_update(g.vehicles, p)


@register("partial_update_notes", """
SELECT id, booking_id, mechanic_id, note, CAST(date AS VARCHAR) AS date, CASE WHEN id % 2 = 0 THEN 'oil' END AS parts_needed,
  CASE WHEN id % 2 = 0 THEN 'done' ELSE status END AS status FROM field_notes""")
def q_partial_update_notes(g):
    """M9: field notes completed with the parts they need."""
    p = g.field_notes.where("id % 2 = 0").select(F.lit(1).alias("patch_seq"), "id", F.lit("oil").alias("parts_needed"), F.lit("done").alias("status"),
                                                 F.array(F.lit("parts_needed"), F.lit("status")).alias("fields"))
    return M.partial_update(g.field_notes, p)


@register("vehicles_seen_by_customers", """
SELECT v.id, v.customer_id, v.license_plate FROM vehicles v
WHERE v.customer_id = (SELECT min(id) FROM customers c WHERE c.user_id IN (SELECT id FROM users WHERE role = 'customer'))""")
def q_vehicles_seen_by_customers(g):
    """P12 ``row_access_filter``: the vehicles that one customer may see, the first by id."""
    first = (g.customers.join(g.users.where("role = 'customer'").select(F.col("id").alias("_u")), F.col("user_id") == F.col("_u"))
             .select(F.min(F.struct("id", "user_id")).alias("f")).select("f.user_id"))
    seen = A.visible_rows(g, "vehicles", first.select("user_id", F.lit("customer").alias("role")))
    return g.vehicles.join(seen.select(F.col("row_id").alias("_r")), F.col("id") == F.col("_r"), "left_semi").select(
        "id", "customer_id", "license_plate")
