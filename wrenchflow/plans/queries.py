"""Registered queries (keys of SURVEY section 2) with their DuckDB oracles.

Parameters are the fixture's: ``AS_OF`` for "today", report ranges inside
the bookings' span.  Every query runs over the whole bound tables.
"""

from __future__ import annotations

from wrenchflow.operators import enrich as J
from wrenchflow.operators import metrics as A
from wrenchflow.plans.catalog import REGISTRY, register
from wrenchflow.sources.binding import AS_OF

# fixture parameters (dates inside the bound data's span)
R_START, R_END = "2000-01-01", "2000-12-31"

# SQL spellings shared by oracles
HHMM = "printf('%02d:%02d', {m} // 60, {m} % 60)"
TS = "strftime({c}, '%Y-%m-%d %H:%M:%S')"
RHU = "floor(({x}) * {s} + 0.5) / {s}"          # round_half_up, digits > 0
RHU0 = "floor(({x}) + 0.5)"                       # round_half_up, digits = 0

J1_SQL = f"""
SELECT b.id, b.visit_id, b.customer_id, b.service_id, b.vehicle_id, CAST(b.booking_date AS VARCHAR) AS booking_date,
  b.start_min, b.status, b.notes, CAST(b.total_price AS DOUBLE) AS total_price, b.rating,
  {TS.format(c='b.started_at')} AS started_at, {TS.format(c='b.completed_at')} AS completed_at, b.created_by,
  s.name AS service_name, CAST(s.price AS DOUBLE) AS service_price, u.name AS customer_name, c.phone AS customer_phone,
  v.make, v.model, v.year, v.license_plate, m.id AS mechanic_id, mu.name AS mechanic_name,
  {HHMM.format(m='b.start_min')} AS booking_time
FROM bookings b
JOIN services s ON b.service_id = s.id
JOIN customers c ON b.customer_id = c.id
JOIN users u ON c.user_id = u.id
JOIN vehicles v ON b.vehicle_id = v.id
LEFT JOIN mechanics m ON b.mechanic_id = m.id
LEFT JOIN users mu ON m.user_id = mu.id
"""


@register("bookings_enriched", J1_SQL)
def q_bookings_enriched(g):
    """Every booking with service, customer, vehicle and mechanic names."""
    return J.bookings_enriched(g)


@register("bookings_by_status", f"""
SELECT status, count(*) AS count FROM bookings
WHERE booking_date >= DATE '{AS_OF}' - INTERVAL 30 DAY GROUP BY status""")
def q_bookings_by_status(g):
    """A7 + L4: bookings of the last 30 days per status, in workflow (CASE) order."""
    return A.bookings_by_status(g, AS_OF)


# ---------------------------------------------------------------- joins (J)
CUST = "customers c JOIN users u ON c.user_id = u.id"
MECH = "mechanics m JOIN users mu ON m.user_id = mu.id"


@register("todays_bookings", J1_SQL + f"WHERE b.booking_date = DATE '{AS_OF}'")
def q_todays_bookings(g):
    """J1 for the bookings of ``AS_OF``."""
    return J.todays_bookings(g, AS_OF)


@register("recent_bookings", f"""
SELECT b.id, CAST(b.booking_date AS VARCHAR) AS booking_date, b.status, CAST(b.total_price AS DOUBLE) AS total_price,
  u.name AS customer_name, s.name AS service_name
FROM bookings b JOIN {CUST} ON b.customer_id = c.id JOIN services s ON b.service_id = s.id
ORDER BY b.booking_date DESC, b.id DESC LIMIT 10""")
def q_recent_bookings(g):
    """Newest ten bookings with customer and service names."""
    return J.recent_bookings(g, 10)


@register("mechanic_roster", """
SELECT m.id, m.user_id, u.name, u.email, u.status, m.specialization, m.experience
FROM mechanics m JOIN users u ON m.user_id = u.id WHERE u.status = 'active'""")
def q_mechanic_roster(g):
    """Active mechanics with their user name."""
    return J.mechanic_roster(g)


TASK_COLS_SQL = f"""
SELECT t.id AS task_id, b.id AS booking_id, t.mechanic_id AS task_mechanic_id, t.status AS task_status,
  t.start_min AS task_start_min, t.end_min AS task_end_min, CAST(b.booking_date AS VARCHAR) AS booking_date,
  b.start_min, b.status AS booking_status, s.name AS service_name, CAST(s.price AS DOUBLE) AS service_price,
  s.estimated_time, b.customer_id, u.name AS customer_name, v.make, v.model, v.license_plate
FROM mechanic_tasks t JOIN bookings b ON t.booking_id = b.id JOIN services s ON b.service_id = s.id
JOIN {CUST} ON b.customer_id = c.id JOIN vehicles v ON b.vehicle_id = v.id"""


@register("mechanic_tasks_view", TASK_COLS_SQL)
def q_mechanic_tasks_view(g):
    """Every task with booking, service, customer and vehicle."""
    return J.mechanic_tasks_view(g)


@register("mechanic_tasks_in_progress", TASK_COLS_SQL + " WHERE t.status = 'in-progress'")
def q_mechanic_tasks_in_progress(g):
    """J5 with a status filter: tasks in progress."""
    return J.mechanic_tasks_view(g, status="in-progress")


OUTER_SQL = f"""
SELECT b.id, b.mechanic_id, CAST(b.booking_date AS VARCHAR) AS booking_date, b.start_min, b.status AS booking_status,
  s.name AS service_name, CAST(s.price AS DOUBLE) AS service_price, s.estimated_time, b.customer_id,
  u.name AS customer_name, v.make, v.model, v.license_plate, t.id AS task_id, t.status AS task_status,
  t.start_min AS task_start_min, t.end_min AS task_end_min, b.notes AS customer_notes
FROM bookings b
LEFT JOIN mechanic_tasks t ON b.id = t.booking_id AND t.mechanic_id = b.mechanic_id
JOIN services s ON b.service_id = s.id JOIN {CUST} ON b.customer_id = c.id JOIN vehicles v ON b.vehicle_id = v.id
WHERE b.mechanic_id IS NOT NULL"""


@register("mechanic_tasks_outer", OUTER_SQL)
def q_mechanic_tasks_outer(g):
    """Every assigned booking with its task, if any (compound LEFT join)."""
    return J.mechanic_tasks_outer(g)


@register("mechanic_tasks_outer_completed",
          OUTER_SQL + f" AND t.status = 'completed' AND b.booking_date BETWEEN DATE '{R_START}' AND DATE '{R_END}'")
def q_mechanic_tasks_outer_completed(g):
    """J6 with task-status and date-range filters."""
    return J.mechanic_tasks_outer(g, status="completed", start=R_START, end=R_END)


@register("field_notes_enriched", f"""
SELECT n.id AS note_id, b.id AS booking_id, n.mechanic_id AS note_mechanic_id, mu.name AS mechanic_name, n.note,
  CAST(n.date AS VARCHAR) AS note_date, n.parts_needed, n.status AS note_status, s.name AS service_name,
  b.customer_id, u.name AS customer_name, v.make, v.model, v.license_plate
FROM field_notes n JOIN bookings b ON n.booking_id = b.id JOIN services s ON b.service_id = s.id
JOIN {CUST} ON b.customer_id = c.id JOIN vehicles v ON b.vehicle_id = v.id
LEFT JOIN {MECH} ON n.mechanic_id = m.id""")
def q_field_notes_enriched(g):
    """Field notes with booking, service, customer, vehicle and mechanic."""
    return J.field_notes_enriched(g)


@register("vehicles_with_owner", f"""
SELECT v.id, v.customer_id, v.make, v.model, v.year, v.license_plate, v.vin, u.name AS owner_name, u.email AS owner_email
FROM vehicles v JOIN {CUST} ON v.customer_id = c.id""")
def q_vehicles_with_owner(g):
    """Vehicles with owner name and e-mail."""
    return J.vehicles_with_owner(g)


@register("tasks_on_dates", f"""
SELECT * FROM mechanic_tasks WHERE booking_id IN
  (SELECT id FROM bookings WHERE booking_date BETWEEN DATE '{R_START}' AND DATE '{R_END}')""")
def q_tasks_on_dates(g):
    """Tasks whose booking lies in the report range (semi join)."""
    return J.tasks_on_dates(g, R_START, R_END)


@register("completed_without_testimonial", """
SELECT b.id, CAST(b.booking_date AS VARCHAR) AS booking_date, b.customer_id, b.service_id, s.name AS service_name, b.mechanic_id
FROM bookings b JOIN services s ON b.service_id = s.id
WHERE b.status = 'completed' AND NOT EXISTS
  (SELECT 1 FROM testimonials t WHERE t.service_id = b.service_id AND t.customer_id = b.customer_id)""")
def q_completed_without_testimonial(g):
    """Completed bookings not yet reviewed (anti join on two keys)."""
    return J.completed_without_testimonial(g)


def _note_refs(g):
    from pyspark.sql import functions as F
    n = g.field_notes
    return n.select(F.col("booking_id").alias("ref")).unionByName(n.select(F.col("id").cast("string").alias("ref")))


@register("resolve_task_or_booking", """
WITH r AS (SELECT DISTINCT ref FROM (SELECT booking_id AS ref FROM field_notes
                                     UNION ALL SELECT CAST(id AS VARCHAR) FROM field_notes)),
bt AS (SELECT r.ref, t.id AS task_id, t.booking_id, t.status AS task_status, t.mechanic_id, 'task' AS matched_by
       FROM r JOIN mechanic_tasks t ON r.ref = CAST(t.id AS VARCHAR)),
bb AS (SELECT r.ref, t.id AS task_id, b.id AS booking_id, t.status AS task_status, b.mechanic_id, 'booking' AS matched_by
       FROM r JOIN bookings b ON r.ref = b.id
       LEFT JOIN mechanic_tasks t ON t.booking_id = b.id AND t.mechanic_id = b.mechanic_id
       WHERE r.ref NOT IN (SELECT ref FROM bt))
SELECT * FROM bt UNION ALL SELECT * FROM bb""")
def q_resolve_task_or_booking(g):
    """References (booking ids and task ids of field notes) resolved to tasks or bookings."""
    return J.resolve_task_or_booking(g, _note_refs(g))


@register("related_bookings", """
WITH bs AS (SELECT b.*, s.price AS service_price FROM bookings b JOIN services s ON b.service_id = s.id),
grp AS (SELECT customer_id, booking_date, start_min, vehicle_id, count(*) AS related_count,
          sum(service_price) AS total_services_price, min(id) AS first_booking_id
        FROM bs GROUP BY 1, 2, 3, 4 HAVING count(*) > 1)
SELECT bs.id, grp.customer_id, CAST(grp.booking_date AS VARCHAR) AS booking_date, grp.start_min, grp.vehicle_id,
  grp.related_count, CAST(grp.total_services_price AS DOUBLE) AS total_services_price, grp.first_booking_id
FROM bs JOIN grp ON bs.customer_id = grp.customer_id AND bs.booking_date = grp.booking_date
  AND bs.start_min = grp.start_min AND bs.vehicle_id = grp.vehicle_id""")
def q_related_bookings(g):
    """Bookings made together, with group size and total service price."""
    return J.related_bookings(g)


PAY_SQL = f"""
SELECT p.id AS payment_id, p.booking_id, p.payment_method, p.is_down_payment, p.down_payment_percent,
  CAST(p.down_payment_amount AS DOUBLE) AS down_payment_amount, p.payment_status, p.admin_notes,
  {TS.format(c='p.payment_date')} AS payment_date, CAST(b.booking_date AS VARCHAR) AS booking_date, b.status,
  CAST(b.total_price AS DOUBLE) AS total_price, b.service_id, s.name AS service_name, CAST(s.price AS DOUBLE) AS service_price,
  u.name AS customer_name, v.make, v.model, v.license_plate, mu.name AS mechanic_name, b.customer_id, b.vehicle_id, v.year, b.mechanic_id,
  {TS.format(c='p.created_at')} AS created_at, {TS.format(c='p.updated_at')} AS updated_at
FROM payments p JOIN bookings b ON p.booking_id = b.id JOIN services s ON b.service_id = s.id
JOIN {CUST} ON b.customer_id = c.id JOIN vehicles v ON b.vehicle_id = v.id
LEFT JOIN {MECH} ON b.mechanic_id = m.id"""


@register("payments_history", PAY_SQL + " WHERE p.payment_status <> 'pending'")
def q_payments_history(g):
    """Settled payments with booking, service, customer, vehicle, mechanic."""
    return J.payments_history(g)


@register("payments_history_search", PAY_SQL + f""" WHERE p.payment_status <> 'pending'
  AND CAST(p.payment_date AS DATE) BETWEEN DATE '{R_START}' AND DATE '{R_END}'
  AND (p.booking_id ILIKE '%7%' OR u.name ILIKE '%7%' OR v.license_plate ILIKE '%7%')""")
def q_payments_history_search(g):
    """J15 with date range and text search over booking id, customer and plate."""
    return J.payments_history(g, start=R_START, end=R_END, term="7")


@register("payments_pending", PAY_SQL + " WHERE p.payment_status = 'pending'")
def q_payments_pending(g):
    """Pending payments."""
    return J.payments_pending(g)


TEST_SQL = f"""
SELECT t.id, t.customer_id, t.service_id, t.mechanic_id, t.rating, t.comment, CAST(t.date AS VARCHAR) AS date,
  t.approved, t.featured, u.name AS customer_name, s.name AS service_name, mu.name AS mechanic_name
FROM testimonials t JOIN {CUST} ON t.customer_id = c.id JOIN services s ON t.service_id = s.id
LEFT JOIN {MECH} ON t.mechanic_id = m.id"""


@register("testimonial_wall", TEST_SQL + " WHERE t.approved")
def q_testimonial_wall(g):
    """Approved testimonials with names."""
    return J.testimonial_wall(g, "approved")


@register("testimonial_wall_featured", TEST_SQL + " WHERE t.approved AND t.featured")
def q_testimonial_wall_featured(g):
    """Featured testimonials."""
    return J.testimonial_wall(g, "featured")


@register("testimonial_wall_pending", TEST_SQL + " WHERE NOT t.approved")
def q_testimonial_wall_pending(g):
    """Testimonials awaiting approval."""
    return J.testimonial_wall(g, "pending")


def _registered_vehicles(g):
    """Parent table with the pre-1995 vehicles removed (deregistered)."""
    from pyspark.sql import functions as F
    return g.vehicles.where(F.col("year") >= 1995)


@register("orphan_bookings", f"""
SELECT b.id, b.vehicle_id, b.customer_id, u.name AS customer_name, s.name AS service_name,
  CAST(b.booking_date AS VARCHAR) AS booking_date
FROM bookings b LEFT JOIN (SELECT * FROM vehicles WHERE year >= 1995) v ON b.vehicle_id = v.id
LEFT JOIN {CUST} ON b.customer_id = c.id LEFT JOIN services s ON b.service_id = s.id
WHERE v.id IS NULL""")
def q_orphan_bookings(g):
    """Bookings whose vehicle is no longer registered (anti join)."""
    return J.orphan_bookings(g, _registered_vehicles(g))


@register("unowned_vehicles", "SELECT * FROM vehicles WHERE customer_id IS NULL")
def q_unowned_vehicles(g):
    """Vehicles without an owner."""
    return J.unowned_vehicles(g)


@register("user_profile", """
SELECT u.id, u.name, u.email, u.role, u.status,
  CASE WHEN u.role = 'mechanic' THEN m.id END AS mechanic_id,
  CASE WHEN u.role = 'mechanic' THEN m.specialization END AS specialization,
  CASE WHEN u.role = 'mechanic' THEN m.experience END AS experience,
  CASE WHEN u.role = 'customer' THEN c.id END AS customer_id,
  CASE WHEN u.role = 'customer' THEN c.address END AS address
FROM users u LEFT JOIN mechanics m ON m.user_id = u.id LEFT JOIN customers c ON c.user_id = u.id""")
def q_user_profile(g):
    """Users with role-specific attributes."""
    return J.user_profile(g)


@register("customer_activity", f"""
SELECT a.id, u.name, u.email, a.total_bookings, CAST(a.total_spent AS DOUBLE) AS total_spent
FROM (SELECT customer_id AS id, count(*) AS total_bookings,
        coalesce(sum(CASE WHEN status = 'completed' THEN total_price END), 0) AS total_spent
      FROM bookings GROUP BY customer_id) a JOIN {CUST} ON a.id = c.id""")
def q_customer_activity(g):
    """Per-customer spend with e-mail."""
    return A.customer_activity(g)


@register("referential_check", """
SELECT b.*, v.id IS NOT NULL AS parent_exists FROM
  (SELECT id, vehicle_id FROM bookings) b
  LEFT JOIN (SELECT DISTINCT id FROM vehicles WHERE year >= 1995) v ON b.vehicle_id = v.id""")
def q_referential_check(g):
    """Each booking flagged by whether its vehicle is still registered."""
    return J.referential_check(g.bookings.select("id", "vehicle_id"), "vehicle_id", _registered_vehicles(g))


# ---------------------------------------------------------------- metrics (A)
def _cnt(s):
    return f"count(*) FILTER (WHERE status = '{s}')"


BUCKETS = f"count(*) AS bookings, {_cnt('completed')} AS completed, {_cnt('cancelled')} AS cancelled"
IN_R = f"booking_date BETWEEN DATE '{R_START}' AND DATE '{R_END}'"
M_START, M_END = "2000-06-01", "2000-06-30"      # monthly report of 2000-06-15
I_START, I_END = "2001-04-15", "2001-07-15"      # quarter before AS_OF
P_START, P_END = "2001-01-15", "2001-04-15"      # the quarter before that


@register("dashboard_stats", f"""
SELECT
  (SELECT {_cnt('pending')} FROM bookings) AS pending_bookings,
  (SELECT {_cnt('confirmed')} FROM bookings) AS confirmed_bookings,
  (SELECT {_cnt('in-progress')} FROM bookings) AS in_progress_bookings,
  (SELECT {_cnt('completed')} FROM bookings) AS completed_bookings,
  (SELECT {_cnt('cancelled')} FROM bookings) AS cancelled_bookings,
  (SELECT count(*) FROM bookings) AS total_bookings,
  (SELECT CAST(coalesce(sum(total_price) FILTER (WHERE status = 'completed'
      AND booking_date >= date_trunc('month', DATE '{AS_OF}')), 0) AS DOUBLE) FROM bookings) AS monthly_revenue,
  (SELECT count(*) FROM mechanics m JOIN users u ON m.user_id = u.id WHERE u.status = 'active') AS active_mechanics,
  (SELECT count(*) FILTER (WHERE approved) FROM testimonials) AS approved_testimonials,
  (SELECT count(*) FILTER (WHERE NOT approved) FROM testimonials) AS pending_testimonials,
  (SELECT count(*) FROM customers) AS total_customers,
  (SELECT count(*) FROM services) AS total_services,
  (SELECT count(*) FROM vehicles) AS total_vehicles,
  (SELECT count(*) FILTER (WHERE type = 'incoming' AND NOT is_read) FROM customer_messages) AS unread_messages,
  (SELECT coalesce({RHU.format(x='avg(rating) FILTER (WHERE approved)', s=100)}, 0.0) FROM testimonials) AS average_rating""")
def q_dashboard_stats(g):
    """A1: one-row dashboard statistics."""
    return A.dashboard_stats(g, AS_OF)


@register("bookings_by_weekday", f"""
SELECT strftime(booking_date, '%a') AS name, CAST(dayofweek(booking_date) AS INT) AS dow, {BUCKETS}
FROM bookings WHERE booking_date >= DATE '{AS_OF}' - INTERVAL 7 DAY GROUP BY 1, 2""")
def q_bookings_by_weekday(g):
    """A2: last 7 days (no upper bound) by weekday."""
    return A.bookings_by_weekday(g, AS_OF)


@register("bookings_by_week", f"""
SELECT CAST(weekofyear(booking_date) AS INT) AS week, {BUCKETS},
  concat('Week ', CAST(weekofyear(booking_date) - weekofyear(DATE '{AS_OF[:8]}01') + 1 AS VARCHAR)) AS name
FROM bookings WHERE booking_date >= date_trunc('month', DATE '{AS_OF}') GROUP BY 1, 5""")
def q_bookings_by_week(g):
    """A3: month to date by ISO week."""
    return A.bookings_by_week(g, AS_OF)


@register("bookings_by_month", f"""
SELECT strftime(booking_date, '%b') AS name, CAST(month(booking_date) AS INT) AS month, {BUCKETS}
FROM bookings WHERE booking_date >= date_trunc('year', DATE '{AS_OF}') GROUP BY 1, 2""")
def q_bookings_by_month(g):
    """A4: year to date by month."""
    return A.bookings_by_month(g, AS_OF)


@register("service_stats", """
SELECT s.name, count(b.id) AS value FROM services s LEFT JOIN bookings b ON s.id = b.service_id
GROUP BY s.name ORDER BY value DESC, s.name LIMIT 5""")
def q_service_stats(g):
    """A5 + L2: top five service names by bookings (ORDER BY ... LIMIT with tie-breaker)."""
    return A.service_stats(g, 5)


@register("mechanic_performance_top", f"""
SELECT name, jobs, rating FROM (
  SELECT u.id, u.name, count(*) FILTER (WHERE b.status = 'completed') AS jobs,
    coalesce({RHU.format(x='avg(b.rating)', s=100)}, 0.0) AS rating
  FROM users u JOIN mechanics m ON u.id = m.user_id LEFT JOIN bookings b ON m.id = b.mechanic_id
  WHERE u.role = 'mechanic' GROUP BY u.id, u.name ORDER BY jobs DESC, u.id LIMIT 5)""")
def q_mechanic_performance_top(g):
    """Top five mechanics by completed jobs with average rating."""
    return A.mechanic_performance_top(g, 5)


@register("mechanic_workload", f"""
SELECT m.id AS mechanic_id, u.name AS mechanic_name,
  count(CASE WHEN b.status = 'pending' THEN 1 END) AS pending_tasks,
  count(CASE WHEN b.status = 'confirmed' THEN 1 END) AS confirmed_tasks,
  count(CASE WHEN b.status = 'in-progress' THEN 1 END) AS in_progress_tasks,
  count(CASE WHEN b.status = 'completed' AND b.booking_date >= DATE '{AS_OF}' - INTERVAL 30 DAY THEN 1 END) AS completed_tasks_30d,
  count(b.id) AS total_tasks
FROM mechanics m JOIN users u ON m.user_id = u.id
LEFT JOIN bookings b ON m.id = b.mechanic_id AND b.booking_date >= DATE '{AS_OF}' - INTERVAL 30 DAY
WHERE u.status = 'active' GROUP BY m.id, u.name""")
def q_mechanic_workload(g):
    """Per active mechanic, bookings of the last 30 days by status."""
    return A.mechanic_workload(g, AS_OF)


@register("service_popularity", f"""
SELECT s.id, s.name, s.category, count(b.id) AS total_bookings,
  count(*) FILTER (WHERE b.status = 'completed') AS completed_bookings,
  {RHU.format(x='avg(b.rating)', s=100)} AS average_rating, CAST(s.price AS DOUBLE) AS price
FROM services s LEFT JOIN bookings b ON s.id = b.service_id GROUP BY s.id, s.name, s.category, s.price""")
def q_service_popularity(g):
    """Per service totals, completed, average rating and price."""
    return A.service_popularity(g)


@register("bookings_by_service", f"""
SELECT s.id AS service_id, s.name AS service_name, s.category, count(b.id) AS booking_count,
  CAST(sum(s.price) AS DOUBLE) AS total_revenue
FROM services s LEFT JOIN bookings b ON s.id = b.service_id
  AND b.booking_date >= DATE '{AS_OF}' - INTERVAL 30 DAY AND b.status != 'cancelled'
GROUP BY s.id, s.name, s.category""")
def q_bookings_by_service(g):
    """A10 (faithful T19 form): per service bookings of the last 30 days and summed price."""
    return A.bookings_by_service(g, AS_OF, 30, faithful=True)


@register("customer_spend", """
SELECT customer_id AS id, count(*) AS total_bookings,
  CAST(coalesce(sum(CASE WHEN status = 'completed' THEN total_price END), 0) AS DOUBLE) AS total_spent
FROM bookings GROUP BY customer_id""")
def q_customer_spend(g):
    """Per customer bookings and completed spend."""
    return A.customer_spend(g)


@register("revenue_by_month", f"""
SELECT strftime(booking_date, '%Y-%m') AS period,
  CAST(coalesce(sum(total_price) FILTER (WHERE status = 'completed'), 0) AS DOUBLE) AS total_revenue,
  {_cnt('completed')} AS completed_bookings
FROM bookings WHERE booking_date BETWEEN DATE '2000-07-15' AND DATE '{AS_OF}' GROUP BY 1""")
def q_revenue_by_month(g):
    """Monthly revenue over the default 12 months up to AS_OF."""
    return A.revenue_by_period(g, "monthly", as_of=AS_OF)


@register("revenue_by_week", f"""
SELECT strftime(date_trunc('week', booking_date), '%Y-%m-%d') AS period,
  CAST(coalesce(sum(total_price) FILTER (WHERE status = 'completed'), 0) AS DOUBLE) AS total_revenue,
  {_cnt('completed')} AS completed_bookings
FROM bookings WHERE {IN_R} GROUP BY 1""")
def q_revenue_by_week(g):
    """Weekly revenue over the report range."""
    return A.revenue_by_period(g, "weekly", R_START, R_END)


@register("revenue_by_year", """
SELECT strftime(booking_date, '%Y') AS period,
  CAST(coalesce(sum(total_price) FILTER (WHERE status = 'completed'), 0) AS DOUBLE) AS total_revenue,
  count(*) FILTER (WHERE status = 'completed') AS completed_bookings
FROM bookings WHERE booking_date BETWEEN DATE '1995-01-01' AND DATE '2001-12-31' GROUP BY 1""")
def q_revenue_by_year(g):
    """Yearly revenue over the whole span."""
    return A.revenue_by_period(g, "yearly", "1995-01-01", "2001-12-31")


@register("bookings_by_hour", f"""
SELECT CAST(floor(start_min / 60) AS BIGINT) AS hour, count(*) AS booking_count FROM bookings
WHERE booking_date >= DATE '{AS_OF}' - INTERVAL 90 DAY AND status != 'cancelled' GROUP BY 1""")
def q_bookings_by_hour(g):
    """Non-cancelled bookings of the last 90 days per hour."""
    return A.bookings_by_hour(g, AS_OF)


@register("pending_testimonials_count", "SELECT count(*) FILTER (WHERE NOT approved) AS pending_count FROM testimonials")
def q_pending_testimonials_count(g):
    """Unapproved testimonials."""
    return A.pending_testimonials_count(g)


@register("booking_report_summary", f"""
SELECT count(*) AS total_bookings, {_cnt('completed')} AS completed_bookings, {_cnt('cancelled')} AS cancelled_bookings,
  coalesce({RHU.format(x="avg(date_diff('second', started_at, completed_at)) / 3600.0", s=10)}, 0.0) AS average_service_time
FROM bookings WHERE {IN_R}""")
def q_booking_report_summary(g):
    """Booking report totals of the report range."""
    return A.booking_report_summary(g, R_START, R_END)


@register("booking_report_detail", f"""
SELECT b.id, CAST(b.booking_date AS VARCHAR) AS date, u.name AS customer_name, s.name AS service_name,
  coalesce(mu.name, '-') AS mechanic_name, b.status,
  CASE WHEN b.completed_at IS NOT NULL AND b.started_at IS NOT NULL
       THEN {RHU.format(x="date_diff('second', b.started_at, b.completed_at) / 3600.0", s=10)} END AS duration
FROM bookings b JOIN {CUST} ON b.customer_id = c.id JOIN services s ON b.service_id = s.id
JOIN vehicles v ON b.vehicle_id = v.id
LEFT JOIN {MECH} ON b.mechanic_id = m.id WHERE b.{IN_R}""")
def q_booking_report_detail(g):
    """A16 + E10: booking report rows of the report range ('-' for no mechanic)."""
    return A.booking_report_detail(g, R_START, R_END)


@register("feedback_report_summary", f"""
SELECT count(*) AS total_testimonials, coalesce({RHU.format(x='avg(rating)', s=100)}, 0.0) AS average_rating,
  CAST(coalesce({RHU0.format(x="count(*) FILTER (WHERE rating >= 4) * 100.0 / nullif(count(*), 0)")}, 0) AS BIGINT) AS satisfaction_rate
FROM testimonials WHERE date >= DATE '{R_START}' AND date < DATE '{R_END}' + INTERVAL 1 DAY""")
def q_feedback_report_summary(g):
    """Testimonial report totals of the report range."""
    return A.feedback_report_summary(g, R_START, R_END)


@register("feedback_report_detail", f"""
SELECT t.id, CAST(t.date AS VARCHAR) AS date, u.name AS customer_name, s.name AS service_name, t.rating, t.comment
FROM testimonials t JOIN {CUST} ON t.customer_id = c.id JOIN services s ON t.service_id = s.id
WHERE t.date >= DATE '{R_START}' AND t.date < DATE '{R_END}' + INTERVAL 1 DAY""")
def q_feedback_report_detail(g):
    """Testimonial report rows of the report range."""
    return A.feedback_report_detail(g, R_START, R_END)


@register("generate_report", f"""
WITH b AS (SELECT b.*, s.name AS service_name, s.price FROM bookings b JOIN services s ON b.service_id = s.id
           WHERE b.booking_date BETWEEN DATE '{M_START}' AND DATE '{M_END}'),
t AS (SELECT count(*) AS total_bookings, {_cnt('completed')} AS completed_bookings, {_cnt('cancelled')} AS cancelled_bookings,
        CAST(coalesce(sum(CASE WHEN status = 'completed' THEN price ELSE 0 END), 0) AS DOUBLE) AS total_revenue,
        {RHU.format(x="avg(CASE WHEN status = 'completed' THEN rating END)", s=100)} AS average_rating FROM b),
ts AS (SELECT service_name AS top_service FROM b GROUP BY service_name ORDER BY count(*) DESC, service_name LIMIT 1),
tm AS (SELECT mu.name AS top_mechanic FROM b JOIN {MECH} ON b.mechanic_id = m.id WHERE b.status = 'completed'
       GROUP BY mu.name ORDER BY count(*) DESC, mu.name LIMIT 1)
SELECT 'monthly' AS report_type, '2000-06-15' AS report_date, '{M_START}' AS start_date, '{M_END}' AS end_date,
  t.*, (SELECT top_service FROM ts) AS top_service, (SELECT top_mechanic FROM tm) AS top_mechanic FROM t""")
def q_generate_report(g):
    """A19 + E7: monthly report for 2000-06-15 (range derived from the report type)."""
    return A.generate_report(g, "monthly", "2000-06-15")


@register("period_growth", f"""
SELECT count(*) FILTER (WHERE {IN_R.replace(R_START, I_START).replace(R_END, I_END)}) AS current_bookings,
  count(*) FILTER (WHERE {IN_R.replace(R_START, P_START).replace(R_END, P_END)}) AS previous_bookings,
  CAST(CASE WHEN previous_bookings > 0 THEN {RHU0.format(x='(current_bookings - previous_bookings) * 100.0 / previous_bookings')}
       ELSE 0 END AS BIGINT) AS growth_rate
FROM bookings""")
def q_period_growth(g):
    """A20 + E8: bookings of the last quarter vs the one before, growth %."""
    return A.period_growth(g, "quarter", AS_OF)


INSIGHT_B = f"""bookings b JOIN services s ON b.service_id = s.id
WHERE b.booking_date BETWEEN DATE '{I_START}' AND DATE '{I_END}'"""


@register("insight_top_service", f"""
SELECT name, bookings, CAST(revenue AS DOUBLE) AS revenue FROM (
  SELECT s.name, count(*) AS bookings, sum(b.total_price) AS revenue, 0 AS p FROM {INSIGHT_B}
  GROUP BY s.name UNION ALL SELECT 'No data', 0, 0, 1) ORDER BY p, bookings DESC, name LIMIT 1""")
def q_insight_top_service(g):
    """Most booked service of the last quarter."""
    return A.insight_top_service(g, "quarter", AS_OF)


@register("insight_top_mechanic", f"""
SELECT name, completed_jobs, rating FROM (
  SELECT mu.name, count(*) AS completed_jobs, {RHU.format(x='avg(b.rating)', s=10)} AS rating, 0 AS p
  FROM bookings b JOIN {MECH} ON b.mechanic_id = m.id
  WHERE b.booking_date BETWEEN DATE '{I_START}' AND DATE '{I_END}' AND b.status = 'completed'
  GROUP BY mu.name UNION ALL SELECT 'No data', 0, 0.0, 1) ORDER BY p, completed_jobs DESC, name LIMIT 1""")
def q_insight_top_mechanic(g):
    """Mechanic with most completed jobs in the last quarter."""
    return A.insight_top_mechanic(g, "quarter", AS_OF)


@register("potential_revenue", f"""
SELECT CAST(coalesce({RHU0.format(x='CAST(sum(s.price) AS DOUBLE) * count(DISTINCT b.booking_date) * 10 / count(s.price)')}, 0)
  AS BIGINT) AS potential FROM {INSIGHT_B}""")
def q_potential_revenue(g):
    """Potential revenue of the last quarter."""
    return A.potential_revenue(g, "quarter", AS_OF)


@register("insight_top_services", f"""
SELECT s.name, count(*) AS bookings, CAST(sum(b.total_price) AS DOUBLE) / 100000 AS revenue FROM {INSIGHT_B}
GROUP BY s.name ORDER BY bookings DESC, s.name LIMIT 5""")
def q_insight_top_services(g):
    """Top five services of the last quarter."""
    return A.insight_top_services(g, "quarter", AS_OF)


@register("report_by_service", f"""
SELECT s.name AS service_name, count(*) AS booking_count,
  count(*) FILTER (WHERE b.status = 'completed') AS completed_count,
  count(*) FILTER (WHERE b.status = 'cancelled') AS cancelled_count,
  CAST(coalesce(sum(b.total_price), 0) AS DOUBLE) AS total_revenue
FROM bookings b JOIN services s ON b.service_id = s.id WHERE b.{IN_R} GROUP BY s.name""")
def q_report_by_service(g):
    """Report range per service name."""
    return A.report_by_service(g, R_START, R_END)


@register("report_by_mechanic", f"""
SELECT mu.name AS mechanic_name, count(*) AS booking_count,
  count(*) FILTER (WHERE b.status = 'completed') AS completed_count,
  {RHU.format(x="avg(CASE WHEN b.status = 'completed' THEN b.rating END)", s=100)} AS average_rating
FROM bookings b JOIN {MECH} ON b.mechanic_id = m.id WHERE b.{IN_R} GROUP BY mu.name""")
def q_report_by_mechanic(g):
    """Report range per mechanic name."""
    return A.report_by_mechanic(g, R_START, R_END)


@register("report_by_day", f"""
SELECT strftime(booking_date, '%Y-%m-%d') AS booking_date, count(*) AS booking_count,
  {_cnt('completed')} AS completed_count, {_cnt('cancelled')} AS cancelled_count,
  CAST(coalesce(sum(total_price), 0) AS DOUBLE) AS daily_revenue
FROM bookings WHERE {IN_R} GROUP BY 1""")
def q_report_by_day(g):
    """Report range per day."""
    return A.report_by_day(g, R_START, R_END)


TOTALS_SQL = f"""count(*) AS total_bookings, {_cnt('completed')} AS completed_bookings,
  {_cnt('cancelled')} AS cancelled_bookings, CAST(coalesce(sum(total_price), 0) AS DOUBLE) AS total_revenue,
  {RHU.format(x="avg(CASE WHEN status = 'completed' THEN rating END)", s=100)} AS average_rating"""


@register("report_totals", f"SELECT {TOTALS_SQL} FROM bookings WHERE {IN_R}")
def q_report_totals(g):
    """Report range totals."""
    return A.report_totals(g, R_START, R_END)


@register("customer_booking_counter", """
SELECT coalesce(c.id, a.customer_id) AS customer_id, c.total_bookings AS stored_bookings,
  coalesce(a.n, 0) AS actual_bookings, c.id IS NOT NULL AS customer_exists
FROM customers c FULL OUTER JOIN (SELECT customer_id, count(*) AS n FROM bookings GROUP BY customer_id) a
  ON c.id = a.customer_id
WHERE c.total_bookings IS DISTINCT FROM coalesce(a.n, 0)""")
def q_customer_booking_counter(g):
    """Customers whose stored booking counter disagrees with the bookings."""
    return A.customer_booking_counter(g)


@register("mechanic_day_week_stats", f"""
SELECT m.id AS mechanic_id,
  coalesce(x.completed_today, 0) AS completed_today, coalesce(x.pending_today, 0) AS pending_today,
  coalesce(x.total_week, 0) AS total_week, coalesce(m.rating, 0.0) AS rating
FROM mechanics m LEFT JOIN (
  SELECT t.mechanic_id,
    count(*) FILTER (WHERE t.status = 'completed' AND b.booking_date = DATE '{AS_OF}') AS completed_today,
    count(*) FILTER (WHERE t.status IN ('pending', 'in-progress') AND b.booking_date = DATE '{AS_OF}') AS pending_today,
    count(*) FILTER (WHERE b.booking_date BETWEEN DATE '2001-07-15' AND DATE '2001-07-21') AS total_week
  FROM mechanic_tasks t JOIN bookings b ON t.booking_id = b.id GROUP BY t.mechanic_id) x ON m.id = x.mechanic_id""")
def q_mechanic_day_week_stats(g):
    """A29 + E9: per mechanic today's and this (Sunday-Saturday) week's task counts."""
    return A.mechanic_day_week_stats(g, AS_OF)


@register("mechanic_performance", f"""
SELECT m.id, mu.name, m.specialization, m.experience, m.rating,
  coalesce(x.completed_jobs, 0) AS completed_jobs, coalesce(x.total_jobs, 0) AS total_jobs,
  CASE WHEN coalesce(x.total_jobs, 0) > 0 THEN {RHU.format(x='x.completed_jobs * 100.0 / x.total_jobs', s=100)} ELSE 0.0 END
    AS completion_rate,
  coalesce(x.upcoming_bookings, 0) AS upcoming_bookings
FROM {MECH} LEFT JOIN (
  SELECT mechanic_id, {_cnt('completed')} AS completed_jobs, count(*) AS total_jobs,
    count(*) FILTER (WHERE booking_date >= DATE '{AS_OF}' AND status IN ('pending', 'confirmed')) AS upcoming_bookings
  FROM bookings WHERE mechanic_id IS NOT NULL GROUP BY mechanic_id) x ON m.id = x.mechanic_id""")
def q_mechanic_performance(g):
    """Per mechanic completion rate and upcoming work."""
    return A.mechanic_performance(g, AS_OF)


@register("user_booking_counts", """
SELECT u.id, u.name, u.email, u.role, u.status,
  CASE WHEN u.role = 'customer' THEN coalesce(x.n, 0) ELSE 0 END AS bookings
FROM users u LEFT JOIN (SELECT c.user_id, count(*) AS n FROM customers c JOIN bookings b ON b.customer_id = c.id
                        GROUP BY c.user_id) x ON u.id = x.user_id""")
def q_user_booking_counts(g):
    """Every user with its booking count."""
    return A.user_booking_counts(g)


@register("page_totals", """
SELECT count(*) AS total_items, 3 AS page, 25 AS page_size, CAST(ceil(count(*) / 25) AS BIGINT) AS total_pages,
  3 < ceil(count(*) / 25) AS has_next, true AS has_previous
FROM bookings WHERE status = 'completed'""")
def q_page_totals(g):
    """Pagination block of the completed-bookings listing (page 3 of 25)."""
    from wrenchflow.functions.predicates import filter_bookings
    return A.page_totals(filter_bookings(g.bookings, status="completed"), 3, 25)


@register("service_usage_counts", """
SELECT s.id AS service_id, count(b.id) AS booking_count FROM services s
LEFT JOIN bookings b ON b.service_id = s.id GROUP BY s.id""")
def q_service_usage_counts(g):
    """Bookings referencing each service."""
    return A.usage_counts(g, "service")


@register("vehicle_usage_counts", """
SELECT v.id AS vehicle_id, count(b.id) AS booking_count FROM vehicles v
LEFT JOIN bookings b ON b.vehicle_id = v.id GROUP BY v.id""")
def q_vehicle_usage_counts(g):
    """Bookings referencing each vehicle."""
    return A.usage_counts(g, "vehicle")


@register("generate_booking_report", f"""
SELECT {TOTALS_SQL},
  coalesce({RHU.format(x="avg(date_diff('second', started_at, completed_at)) / 3600.0", s=10)}, 0.0) AS average_service_time
FROM bookings WHERE {IN_R}""")
def q_generate_booking_report(g):
    """Booking report bundle of the report range."""
    return A.generate_booking_report(g, R_START, R_END)


@register("upcoming_bookings", f"""
SELECT b.id, CAST(b.booking_date AS VARCHAR) AS booking_date, b.start_min, b.status, u.name AS customer_name,
  s.name AS service_name, mu.name AS mechanic_name, v.make, v.model, v.license_plate
FROM bookings b
JOIN services s ON b.service_id = s.id JOIN {CUST} ON b.customer_id = c.id JOIN vehicles v ON b.vehicle_id = v.id
LEFT JOIN {MECH} ON b.mechanic_id = m.id
WHERE b.booking_date >= DATE '{AS_OF}' AND b.status NOT IN ('cancelled', 'completed')
ORDER BY b.booking_date, b.start_min, b.id LIMIT 10""")
def q_upcoming_bookings(g):
    """Next ten live bookings from AS_OF."""
    return A.upcoming_bookings(g, AS_OF)


# ---------------------------------------------------------------- intervals
from wrenchflow.operators import intervals as IV  # noqa: E402

SLOT_DATE = "2001-07-16"    # a Monday after AS_OF
IV_SQL = """iv AS (SELECT b.id, b.mechanic_id, b.booking_date, b.start_min,
    b.start_min + coalesce(nullif(s.estimated_time, 0), 60) AS end_min
  FROM bookings b LEFT JOIN services s ON b.service_id = s.id
  WHERE b.mechanic_id IS NOT NULL AND b.status <> 'cancelled')"""


@register("schedule_conflicts", f"""
WITH {IV_SQL}
SELECT a.id, a.mechanic_id, CAST(a.booking_date AS VARCHAR) AS booking_date, a.start_min, a.end_min,
  count(*) - 1 AS conflict_count, count(*) > 1 AS has_conflict
FROM iv a JOIN iv o ON a.mechanic_id = o.mechanic_id AND a.booking_date = o.booking_date
  AND o.start_min < a.end_min AND o.end_min > a.start_min
GROUP BY a.id, a.mechanic_id, a.booking_date, a.start_min, a.end_min""")
def q_schedule_conflicts(g):
    """J12 + E6: per live assigned booking (end = start + estimate, default 60), overlapping bookings of the same mechanic and day."""
    return IV.schedule_conflicts(g)


@register("within_availability", f"""
WITH {IV_SQL}
SELECT iv.id, iv.mechanic_id, CAST(iv.booking_date AS VARCHAR) AS booking_date, iv.start_min, iv.end_min,
  CAST(dayofweek(iv.booking_date) AS INT) AS dow,
  EXISTS (SELECT 1 FROM mechanic_availability a WHERE a.mechanic_id = iv.mechanic_id
          AND a.day_of_week = dayofweek(iv.booking_date) AND a.start_min <= iv.start_min AND a.end_min >= iv.end_min)
    AS within_availability
FROM iv""")
def q_within_availability(g):
    """Each live assigned booking flagged by availability containment."""
    return IV.within_availability(g).select("id", "mechanic_id", "booking_date", "start_min", "end_min", "dow",
                                            "within_availability")


@register("available_time_slots", f"""
WITH d AS (SELECT coalesce(max(estimated_time), 60) AS dur FROM services WHERE id = 1),
win AS (SELECT a.mechanic_id, a.start_min, a.end_min, d.dur FROM mechanic_availability a, d
        WHERE a.day_of_week = dayofweek(DATE '{SLOT_DATE}') AND a.end_min - d.dur >= a.start_min),
slots AS (SELECT DISTINCT mechanic_id, dur, unnest(range(start_min, end_min - dur + 1, 30)) AS slot_start FROM win),
busy AS (SELECT b.mechanic_id, b.start_min, b.start_min + coalesce(nullif(s.estimated_time, 0), 60) AS end_min
         FROM bookings b LEFT JOIN services s ON b.service_id = s.id
         WHERE b.booking_date = DATE '{SLOT_DATE}' AND b.mechanic_id IS NOT NULL AND b.status <> 'cancelled')
SELECT s.mechanic_id, '{SLOT_DATE}' AS booking_date, CAST(s.slot_start AS INT) AS slot_start,
  CAST(s.slot_start + s.dur AS INT) AS slot_end, {HHMM.format(m='CAST(s.slot_start AS INT)')} AS slot_time
FROM slots s WHERE NOT EXISTS (SELECT 1 FROM busy WHERE busy.mechanic_id = s.mechanic_id
  AND busy.start_min < s.slot_start + s.dur AND busy.end_min > s.slot_start)""")
def q_available_time_slots(g):
    """free 30-minute-grid start times for service 1 on SLOT_DATE, all mechanics."""
    return IV.available_time_slots(g, SLOT_DATE, service_id=1)


def visit_assignment_requests(g):
    """Stand-in requests: each pending booking asks for the lowest-numbered mechanic already working on the same
    visit, then again for the highest-numbered one; each confirmed booking with a mechanic asks to move to the
    lowest-numbered one.  Request order = booking key, second requests after all first ones."""
    from pyspark.sql import functions as F
    b = g.bookings
    crew = b.where(F.col("mechanic_id").isNotNull()).groupBy("visit_id").agg(
        F.min("mechanic_id").alias("low"), F.max("mechanic_id").alias("high"))
    r = (b.where(F.col("status").isin("pending", "confirmed")).join(crew, "visit_id")
         .withColumn("seq", F.substring("id", 3, 40).cast("long")))
    first = r.select(F.col("id").alias("booking_id"), F.col("low").alias("mechanic_id"), F.col("seq").alias("request_seq"))
    again = r.where(F.col("status") == "pending").select(
        F.col("id").alias("booking_id"), F.col("high").alias("mechanic_id"), (F.col("seq") + SI.BIG).alias("request_seq"))
    return first.unionByName(again)


# Oracle: the checks against bookings no request names, then the sequential rule replayed by a recursive CTE per
# date (depth = the largest group), carrying the named bookings' current slots as a list.
M4_SQL = """WITH RECURSIVE
crew AS (SELECT visit_id, min(mechanic_id) AS low, max(mechanic_id) AS high FROM bookings WHERE mechanic_id IS NOT NULL GROUP BY visit_id),
req AS (SELECT b.id AS booking_id, c.low AS mechanic_id, CAST(substr(b.id, 3) AS BIGINT) AS request_seq
        FROM bookings b JOIN crew c ON b.visit_id = c.visit_id WHERE b.status IN ('pending', 'confirmed')
        UNION ALL
        SELECT b.id, c.high, CAST(substr(b.id, 3) AS BIGINT) + 1000000000000
        FROM bookings b JOIN crew c ON b.visit_id = c.visit_id WHERE b.status = 'pending'),
bi AS (SELECT b.id, b.booking_date, b.start_min, b.start_min + coalesce(nullif(s.estimated_time, 0), 60) AS end_min,
         b.mechanic_id AS cur_mech, b.status AS cur_status FROM bookings b LEFT JOIN services s ON b.service_id = s.id),
live AS (SELECT * FROM bi WHERE cur_mech IS NOT NULL AND cur_status <> 'cancelled'),
fixed AS (SELECT * FROM live WHERE id NOT IN (SELECT booking_id FROM req)),
x AS (SELECT r.*, bi.booking_date, bi.start_min, bi.end_min, bi.id IS NOT NULL AS has_b,
        r.mechanic_id IN (SELECT id FROM mechanics) AS has_m FROM req r LEFT JOIN bi ON r.booking_id = bi.id),
chk AS (SELECT x.*,
  CASE WHEN NOT has_b THEN 'booking not found'
       WHEN NOT coalesce(has_m, false) THEN 'mechanic not found'
       WHEN NOT EXISTS (SELECT 1 FROM mechanic_availability a WHERE a.mechanic_id = x.mechanic_id
                        AND a.day_of_week = dayofweek(x.booking_date) AND a.start_min <= x.start_min
                        AND a.end_min >= x.end_min) THEN 'outside availability'
       WHEN EXISTS (SELECT 1 FROM fixed l WHERE l.cur_mech = x.mechanic_id AND l.booking_date = x.booking_date
             AND l.start_min < x.end_min AND l.end_min > x.start_min) THEN 'schedule conflict' END AS reject_reason FROM x),
cand AS (SELECT request_seq, booking_id, mechanic_id, booking_date, start_min, end_min,
           row_number() OVER (PARTITION BY booking_date ORDER BY request_seq) AS rn FROM chk WHERE reject_reason IS NULL),
seed AS (SELECT booking_date, list({'b': id, 'm': cur_mech, 's': start_min, 'e': end_min, 'stored': true}) AS acc
         FROM live WHERE id IN (SELECT booking_id FROM req) GROUP BY booking_date),
rec(booking_date, rn, acc, request_seq, why) AS (
  SELECT d.booking_date, CAST(0 AS BIGINT), coalesce(seed.acc, []), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR)
  FROM (SELECT DISTINCT booking_date FROM cand) d LEFT JOIN seed ON d.booking_date = seed.booking_date
  UNION ALL
  SELECT booking_date, rn, CASE WHEN why IS NULL THEN
      list_append(list_filter(acc, lambda a: a.b <> booking_id), {'b': booking_id, 'm': mechanic_id, 's': start_min, 'e': end_min, 'stored': false})
    ELSE acc END, request_seq, why
  FROM (SELECT r.booking_date, c.rn, r.acc, c.request_seq, c.booking_id, c.mechanic_id, c.start_min, c.end_min,
      CASE WHEN len(list_filter(r.acc, lambda a: a.stored AND a.b <> c.booking_id AND a.m = c.mechanic_id AND a.s < c.end_min AND a.e > c.start_min)) > 0
             THEN 'schedule conflict'
           WHEN len(list_filter(r.acc, lambda a: a.b <> c.booking_id AND a.m = c.mechanic_id AND a.s < c.end_min AND a.e > c.start_min)) > 0
             THEN 'conflict within batch' END AS why
    FROM rec r JOIN cand c ON c.booking_date = r.booking_date AND c.rn = r.rn + 1)),
fin AS (SELECT c.*, coalesce(c.reject_reason, rec.why) AS reason FROM chk c LEFT JOIN rec ON c.request_seq = rec.request_seq)
SELECT booking_id, mechanic_id, request_seq, CAST(booking_date AS VARCHAR) AS booking_date, start_min, end_min,
  reason AS reject_reason, CASE WHEN reason IS NULL THEN 'confirmed' END AS new_status,
  CASE WHEN reason IS NULL THEN 'pending' END AS task_status
FROM fin"""


@register("assign_mechanics", M4_SQL)
def q_assign_mechanics(g):
    """M4: batch mechanic assignment with availability, conflicts and in-batch order (oracle: recursive CTE)."""
    return IV.assign_mechanics(g, visit_assignment_requests(g))


# ---------------------------------------------------------------- nested documents (N)
from pyspark.sql import functions as _F  # noqa: E402

from wrenchflow.operators import nested as N  # noqa: E402


def _render(arr, *fields, sep=";"):
    """Array of structs -> 'f1:f2;f1:f2' text, for flat comparison."""
    return _F.array_join(_F.transform(_F.col(arr), lambda t: _F.concat_ws(":", *[t[f].cast("string") for f in fields])),
                         sep)


def _agg_sql(table, fields, where, order):
    cols = ", ".join(f"CAST({f} AS VARCHAR)" for f in fields)
    return f"coalesce((SELECT string_agg(concat_ws(':', {cols}), ';' ORDER BY {order}) FROM {table} x WHERE {where}), '')"


@register("booking_document", f"""
SELECT b.id, CAST(b.booking_date AS VARCHAR) AS booking_date, b.start_min, b.status, b.customer_id, b.service_id,
  b.vehicle_id, b.mechanic_id, 0 AS part,
  {_agg_sql('mechanic_tasks', ['x.id', 'x.status'], 'x.booking_id = b.id', 'x.id')} AS tasks_text,
  {_agg_sql('field_notes', ['x.id', 'x.note'], 'x.booking_id = b.id', 'x.date DESC, x.id DESC')} AS notes_text,
  {_agg_sql('customer_messages', ['x.turn', 'x.type', 'x.message'], 'x.booking_id = b.id', 'x.turn, x.customer_id')} AS messages_text
FROM bookings b""")
def q_booking_document(g):
    """Booking + tasks[] + field_notes[] + messages[] (arrays rendered as text)."""
    d = N.booking_document(g)
    return d.select("id", "booking_date", "start_min", "status", "customer_id", "service_id", "vehicle_id",
                    "mechanic_id", "part", _render("tasks", "id", "status").alias("tasks_text"),
                    _render("field_notes", "id", "note").alias("notes_text"),
                    _render("messages", "turn", "type", "message").alias("messages_text"))


@register("mechanic_document", f"""
SELECT m.id, m.user_id, m.specialization, m.experience, p.name, p.completed_jobs, p.total_jobs, p.completion_rate,
  p.upcoming_bookings, 0 AS part,
  {_agg_sql('mechanic_availability', ['x.day_of_week', 'x.start_min', 'x.end_min'], 'x.mechanic_id = m.id',
            'x.day_of_week, x.start_min, x.end_min')} AS availability_text,
  {_agg_sql('testimonials', ['x.id', 'x.rating'], 'x.mechanic_id = m.id AND x.approved', 'x.date DESC, x.id DESC')}
    AS testimonials_text
FROM mechanics m LEFT JOIN (
  SELECT m.id, mu.name, coalesce(x.completed_jobs, 0) AS completed_jobs, coalesce(x.total_jobs, 0) AS total_jobs,
    CASE WHEN coalesce(x.total_jobs, 0) > 0 THEN {RHU.format(x='x.completed_jobs * 100.0 / x.total_jobs', s=100)} ELSE 0.0 END
      AS completion_rate, coalesce(x.upcoming_bookings, 0) AS upcoming_bookings
  FROM {MECH} LEFT JOIN (
    SELECT mechanic_id, {_cnt('completed')} AS completed_jobs, count(*) AS total_jobs,
      count(*) FILTER (WHERE booking_date >= DATE '{AS_OF}' AND status IN ('pending', 'confirmed')) AS upcoming_bookings
    FROM bookings WHERE mechanic_id IS NOT NULL GROUP BY mechanic_id) x ON m.id = x.mechanic_id) p ON m.id = p.id""")
def q_mechanic_document(g):
    """Mechanic + availability[] + performance{} + testimonials[]."""
    d = N.mechanic_document(g, AS_OF)
    return d.select("id", "user_id", "specialization", "experience", "name", "performance.completed_jobs",
                    "performance.total_jobs", "performance.completion_rate", "performance.upcoming_bookings", "part",
                    _render("availability", "day_of_week", "start_min", "end_min").alias("availability_text"),
                    _render("testimonials", "id", "rating").alias("testimonials_text"))


@register("service_document", f"""
SELECT s.id, s.name, s.category, CAST(s.price AS DOUBLE) AS price, 0 AS part,
  {_agg_sql('testimonials', ['x.id', 'x.rating'], 'x.service_id = s.id AND x.approved', 'x.date DESC, x.id DESC')}
    AS testimonials_text
FROM services s""")
def q_service_document(g):
    """Service + approved testimonials[]."""
    d = N.service_document(g)
    return d.select("id", "name", "category", "price", "part", _render("testimonials", "id", "rating").alias("testimonials_text"))


@register("vehicle_document", f"""
SELECT v.id, v.customer_id, v.make, v.model, v.year, v.license_plate, u.name AS owner_name, 0 AS part,
  {_agg_sql('bookings', ['x.id', 'x.status'], 'x.vehicle_id = v.id', 'x.booking_date DESC, x.start_min DESC, x.id DESC')}
    AS history_text
FROM vehicles v LEFT JOIN {CUST} ON v.customer_id = c.id""")
def q_vehicle_document(g):
    """Vehicle + booking history[] newest first."""
    d = N.vehicle_document(g)
    return d.select("id", "customer_id", "make", "model", "year", "license_plate", "owner_name", "part",
                    _render("booking_history", "id", "status").alias("history_text"))


@register("task_document", f"""
SELECT t.id, t.booking_id, t.mechanic_id, t.status, t.start_min, t.end_min, 0 AS part,
  {_agg_sql('field_notes', ['x.id', 'x.note'], 'x.booking_id = t.booking_id AND x.mechanic_id = t.mechanic_id',
            'x.date DESC, x.id DESC')} AS notes_text
FROM mechanic_tasks t""")
def q_task_document(g):
    """Task + its field notes[]."""
    d = N.task_document(g)
    return d.select("id", "booking_id", "mechanic_id", "status", "start_min", "end_min", "part",
                    _render("field_notes", "note_id", "note").alias("notes_text"))


def _invoice_sql(tax: str, which: str) -> str:
    return f"""
SELECT p.id, {TS.format(c='p.created_at')} AS created_at, {TS.format(c='p.updated_at')} AS updated_at, p.booking_id,
  concat('INV/', strftime(p.created_at, '%Y/%m'), '/', CAST(p.id AS VARCHAR)) AS invoice_number, b.customer_id,
  coalesce(u.name, 'Unknown Customer') AS customer_name, b.vehicle_id, coalesce(v.make, '') AS vehicle_make, coalesce(v.model, '') AS vehicle_model,
  v.year AS vehicle_year, coalesce(v.license_plate, '') AS vehicle_plate, CAST(b.booking_date AS VARCHAR) AS service_date,
  {TS.format(c='p.payment_date')} AS payment_date,
  concat('S', CAST(b.service_id AS VARCHAR)) AS item_id, coalesce(s.name, 'Unknown Service') AS item_name,
  CAST(s.price AS DOUBLE) AS subtotal, {tax} AS tax,
  CAST(CASE WHEN p.is_down_payment THEN p.down_payment_amount ELSE s.price END AS DOUBLE) AS total_amount,
  p.payment_method, p.is_down_payment, p.down_payment_percent, CAST(p.down_payment_amount AS DOUBLE) AS down_payment_amount,
  p.payment_status AS status, CASE WHEN p.payment_status = 'approved' THEN 'paid' ELSE 'unpaid' END AS payment_label, b.mechanic_id,
  coalesce(mu.name, 'Belum ditugaskan') AS mechanic_name,
  CASE WHEN p.payment_status = 'approved' THEN 'Admin' END AS approved_by,
  CASE WHEN p.payment_status = 'approved' THEN {TS.format(c='p.updated_at')} END AS approved_at,
  CASE WHEN p.payment_status = 'rejected' THEN 'Admin' END AS rejected_by,
  CASE WHEN p.payment_status = 'rejected' THEN {TS.format(c='p.updated_at')} END AS rejected_at,
  CASE WHEN p.payment_status = 'rejected' THEN p.admin_notes END AS rejection_reason,
  coalesce(p.admin_notes, '') AS admin_notes
FROM payments p JOIN bookings b ON p.booking_id = b.id JOIN services s ON b.service_id = s.id
JOIN {CUST} ON b.customer_id = c.id JOIN vehicles v ON b.vehicle_id = v.id
LEFT JOIN {MECH} ON b.mechanic_id = m.id WHERE p.payment_status {which} 'pending'"""


def _invoice(d):
    item = _F.col("service_items")[0]
    return d.withColumn("item_id", item["item_id"]).withColumn("item_name", item["name"]).drop("service_items")


@register("payment_document", _invoice_sql("CAST(round(s.price * CAST(0.10 AS DECIMAL(4,2)), 2) AS DOUBLE)", "<>"))
def q_payment_document(g):
    """Settled payments as invoices (E2 number, E3 amounts, E4 labels, E5 items)."""
    return _invoice(N.payment_document(g))


@register("payment_document_pending", _invoice_sql("CAST(0 AS DOUBLE)", "="))
def q_payment_document_pending(g):
    """N6 + E3: pending payments as invoices, without tax."""
    return _invoice(N.payment_document(g, settled=False))


# ---------------------------------------------------------------- scans, search, paging, distinct
from wrenchflow.functions.predicates import filter_bookings  # noqa: E402
from wrenchflow.operators import listing as L  # noqa: E402
from wrenchflow.operators import messages as G  # noqa: E402
from wrenchflow.operators import quality as Q  # noqa: E402


@register("schedule_scan", f"""
SELECT id, CAST(booking_date AS VARCHAR) AS booking_date, start_min, {HHMM.format(m='start_min')} AS booking_time, status
FROM bookings""")
def q_schedule_scan(g):
    """Schedule projection, newest date first, time ascending."""
    return L.schedule_scan(g)


@register("filter_bookings", J1_SQL + " WHERE b.status = 'completed' AND (u.name ILIKE '%9%' OR s.name ILIKE '%anvil%')")
def q_filter_bookings(g):
    """J1 with status and text filters AND-ed ('anvil' or '9' in names)."""
    from pyspark.sql import functions as F
    from wrenchflow.functions.predicates import contains_ci
    e = filter_bookings(J.bookings_enriched(g), status="completed")
    return e.where(contains_ci(["customer_name"], "9") | contains_ci(["service_name"], "anvil"))


@register("search_bookings", J1_SQL + " WHERE u.name ILIKE '%gear%' OR s.name ILIKE '%gear%'")
def q_search_bookings(g):
    """Bookings whose customer or service name contains 'gear'."""
    return L.search_bookings(g, "gear")


SVC_COLS = ("id, name, description, category, CAST(price AS DOUBLE) AS price, estimated_time, stock > 0 AS in_stock, "
            "featured, stock")


@register("search_services", f"SELECT {SVC_COLS} FROM services WHERE name ILIKE '%gear%' OR description ILIKE '%gear%'")
def q_search_services(g):
    """P3 + E11: services whose name or description contains 'gear', with in_stock = stock > 0."""
    return L.search_services(g, term="gear")


@register("services_by_category", f"SELECT {SVC_COLS} FROM services WHERE category = 'PROMO'")
def q_services_by_category(g):
    """Services of one category."""
    return L.search_services(g, category="PROMO")


@register("services_featured", f"SELECT {SVC_COLS} FROM services WHERE featured")
def q_services_featured(g):
    """Featured services."""
    return L.search_services(g, featured=True)


@register("search_vehicles", f"""
SELECT v.id, v.customer_id, v.make, v.model, v.year, v.license_plate, v.vin, u.name AS owner_name
FROM vehicles v LEFT JOIN {CUST} ON v.customer_id = c.id
WHERE v.license_plate ILIKE '%77%' OR v.vin ILIKE '%77%'""")
def q_search_vehicles(g):
    """Vehicles whose plate or VIN contains '77', with owner."""
    return L.search_vehicles(g, "77")


INITIALS_SQL = ("upper(substr(array_to_string(list_transform(list_filter(string_split(name, ' '), lambda w: w <> ''), "
                "lambda w: substr(w, 1, 1)), ''), 1, 2))")


@register("search_users", f"""
SELECT id, name, email, role, status, {INITIALS_SQL} AS initials FROM users
WHERE (name ILIKE '%00001%' OR email ILIKE '%00001%') AND role IN ('customer', 'mechanic')""")
def q_search_users(g):
    """P5 + E1: users matching '00001' in name or e-mail among two roles, with initials."""
    return L.search_users(g, "00001", ["customer", "mechanic"])


@register("users_by_role", f"SELECT id, name, email, role, status, {INITIALS_SQL} AS initials FROM users WHERE role = 'mechanic'")
def q_users_by_role(g):
    """Users of one role."""
    return L.search_users(g, roles="mechanic")


@register("duplicate_testimonials", """
SELECT customer_id, service_id, mechanic_id, count(*) AS row_count FROM testimonials
GROUP BY customer_id, service_id, mechanic_id HAVING count(*) > 1""")
def q_duplicate_testimonials(g):
    """Reviews repeating (customer, service, mechanic) with NULL-safe equality."""
    return Q.duplicate_keys(g.testimonials, ["customer_id", "service_id", "mechanic_id"])


@register("visible_bookings", """
SELECT u.id AS user_id, u.role, b.id AS booking_id, 'own' AS scope
FROM users u JOIN customers c ON c.user_id = u.id JOIN bookings b ON b.customer_id = c.id WHERE u.role = 'customer'
UNION ALL
SELECT u.id, u.role, b.id, 'assigned' FROM users u JOIN mechanics m ON m.user_id = u.id
JOIN bookings b ON b.mechanic_id = m.id WHERE u.role = 'mechanic'
UNION ALL
SELECT id, role, NULL, 'all' FROM users WHERE role IN ('admin', 'staff', 'owner')""")
def q_visible_bookings(g):
    """Row-level visibility of bookings for every user."""
    return L.visible_bookings(g)


@register("vehicles_by_customer", "SELECT * FROM vehicles WHERE customer_id IS NOT NULL")
def q_vehicles_by_customer(g):
    """Every customer's vehicles ordered by make and model."""
    return L.vehicles_by_customer(g)


@register("availability_by_mechanic", f"""
SELECT mechanic_id, day_of_week, start_min, end_min, {HHMM.format(m='start_min')} AS start_time,
  {HHMM.format(m='end_min')} AS end_time FROM mechanic_availability""")
def q_availability_by_mechanic(g):
    """Weekly windows per mechanic."""
    return L.availability_by_mechanic(g)


@register("bookings_page", J1_SQL + " ORDER BY b.booking_date DESC, b.start_min DESC, b.id LIMIT 25 OFFSET 50")
def q_bookings_page(g):
    """L1 + L3: third page of 25 of the newest-first enriched listing."""
    from pyspark.sql import functions as F
    order = [F.col("booking_date").desc_nulls_first(), F.col("start_min").desc_nulls_first(), F.col("id").asc()]
    return L.bookings_page(g, order, page=3, size=25)


@register("service_categories", "SELECT DISTINCT category FROM services WHERE category IS NOT NULL")
def q_service_categories(g):
    """Distinct service categories."""
    return L.service_categories(g)


@register("service_name_uniqueness", f"""
SELECT {SVC_COLS.replace('stock > 0 AS in_stock', 's.in_stock').replace('id,', 's.id,', 1).replace(' name,', ' s.name,', 1)},
  coalesce(x.n > 1 OR x.lo <> s.id OR x.hi <> s.id, false) AS taken_by_other,
  coalesce(x.n > 1, false) AS duplicate_in_batch
FROM services s LEFT JOIN (SELECT name, count(*) AS n, min(id) AS lo, max(id) AS hi FROM services GROUP BY name) x
  ON s.name = x.name""")
def q_service_name_uniqueness(g):
    """Services whose name is used by another service or repeats in the batch."""
    return L.uniqueness_check(g.services, g.services, "name")


# ---------------------------------------------------------------- messages (G)
MSG_SQL = f"""SELECT m.customer_id, m.turn, m.type, m.is_read, m.message, m.staff_id, m.booking_id, u.name AS customer_name,
  su.name AS staff_name, s.name AS service_name
FROM customer_messages m LEFT JOIN {CUST} ON m.customer_id = c.id LEFT JOIN users su ON su.id = m.staff_id
LEFT JOIN bookings b ON b.id = m.booking_id LEFT JOIN services s ON s.id = b.service_id"""


@register("messages_by_customer", MSG_SQL)
def q_messages_by_customer(g):
    """G1: message threads with the names of customer, staff and service."""
    return G.messages_by_customer(g)


@register("messages_by_booking", MSG_SQL + " WHERE m.booking_id IS NOT NULL")
def q_messages_by_booking(g):
    """G1: the messages about each booking, with the same names."""
    return G.messages_by_booking(g)


@register("unread_messages", MSG_SQL + " WHERE m.type = 'incoming' AND NOT m.is_read")
def q_unread_messages(g):
    """Unread incoming messages, with the same names."""
    return G.unread_messages(g)


@register("mark_read", """
SELECT m.customer_id, m.turn, m.type, m.is_read OR coalesce(m.type = 'incoming' AND m.turn <= r.up_to_turn, false) AS is_read,
  m.message, m.staff_id, m.booking_id
FROM customer_messages m LEFT JOIN (SELECT customer_id, max(turn) AS up_to_turn FROM customer_messages
                                    WHERE type = 'outgoing' GROUP BY customer_id) r ON m.customer_id = r.customer_id""")
def q_mark_read(g):
    """Read receipts implied by staff replies applied to the threads."""
    return G.mark_read(g.customer_messages, G.reply_receipts(g.customer_messages))


# ---------------------------------------------------------------- data quality (D)
MAX_YEAR = int(AS_OF[:4]) + 1
_PRESENT = "coalesce(trim(CAST({c} AS VARCHAR)) <> '', false)"
VEHICLE_RULES_SQL = [
    ("make", Q.MSG_MAKE, f"NOT {_PRESENT.format(c='make')}"),
    ("model", Q.MSG_MODEL, f"NOT {_PRESENT.format(c='model')}"),
    ("year", Q.MSG_YEAR, f"NOT coalesce(year BETWEEN 1900 AND {MAX_YEAR}, false)"),
    ("license_plate", Q.MSG_PLATE_EMPTY, f"NOT {_PRESENT.format(c='license_plate')}"),
    ("license_plate", Q.MSG_PLATE_FORMAT, f"NOT coalesce(regexp_matches(license_plate, '{Q.PLATE_RE}'), false)"),
    ("vin", Q.MSG_VIN_LEN, "vin IS NOT NULL AND vin <> '' AND length(vin) <> 17"),
    ("vin", Q.MSG_VIN_FORMAT, f"vin IS NOT NULL AND vin <> '' AND NOT regexp_matches(vin, '{Q.VIN_RE}')"),
    ("customer_id", Q.MSG_CUSTOMER_ID, "customer_id IS NOT NULL AND customer_id < 1"),
]


@register("validate_vehicles", "SELECT id, concat_ws(';', "
          + ", ".join(f"CASE WHEN {cond} THEN '{f}:{m}' END" for f, m, cond in VEHICLE_RULES_SQL)
          + ") AS errors_text, " + " + ".join(f"CAST({cond} AS INT)" for _, _, cond in VEHICLE_RULES_SQL)
          + " AS error_count FROM vehicles")
def q_validate_vehicles(g):
    """Vehicle rule chain; errors rendered as 'field:message;...'."""
    from pyspark.sql import functions as F
    v = Q.validate(g.vehicles, Q.vehicle_rules(MAX_YEAR))
    return v.select("id", _render("errors", "field", "message").alias("errors_text"),
                    F.size("errors").alias("error_count"))


@register("vehicle_quality_report", "SELECT field, message, count(*) AS error_count, 'vehicles' AS table_name FROM ("
          + " UNION ALL ".join(f"SELECT '{f}' AS field, '{m}' AS message FROM vehicles WHERE {cond}"
                               for f, m, cond in VEHICLE_RULES_SQL)
          + ") GROUP BY field, message")
def q_vehicle_quality_report(g):
    """Vehicle error counts per field and message."""
    return Q.quality_report(Q.validate(g.vehicles, Q.vehicle_rules(MAX_YEAR)), "vehicles")


def _schema_check_sql(table: str) -> str:
    """Oracle for D3: the bound table conforms to the model, so types are the model's; NULL counts in SQL."""
    from wrenchflow.model import SCHEMAS
    parts = [f"SELECT '{f.name}' AS column_name, '{f.dataType.simpleString()}' AS expected_type, "
             f"'{f.dataType.simpleString()}' AS actual_type, count(*) FILTER (WHERE {f.name} IS NULL) AS null_count, "
             f"true AS present, true AS type_matches, '{table}' AS table_name FROM {table}"
             for f in SCHEMAS[table].fields]
    return "\nUNION ALL\n".join(parts)


@register("schema_check_bookings", _schema_check_sql("bookings"))
def q_schema_check_bookings(g):
    """D3: bookings columns vs the model schema, with NULL counts per column."""
    return Q.schema_check(g.bookings, "bookings")


@register("status_vocabulary_check", """
SELECT status, count(*) AS row_count,
  coalesce(status IN ('pending', 'confirmed', 'in-progress', 'completed', 'cancelled'), false) AS in_vocabulary,
  CASE WHEN NOT coalesce(status IN ('pending', 'confirmed', 'in-progress', 'completed', 'cancelled'), false)
        AND replace(status, '_', '-') IN ('pending', 'confirmed', 'in-progress', 'completed', 'cancelled')
       THEN replace(status, '_', '-') END AS repair
FROM mechanic_tasks GROUP BY status""")
def q_status_vocabulary_check(g):
    """Task statuses against the booking vocabulary."""
    return Q.status_vocabulary_check(g.mechanic_tasks)


# ---------------------------------------------------------------- batch state changes (M)
import uuid as _uuid  # noqa: E402

from wrenchflow.operators import changes as M  # noqa: E402
from wrenchflow.plans import standins as SI  # noqa: E402

BIG = SI.BIG
NUM = "CAST(substr({c}, 3) AS BIGINT)"
LEAD_SQL = "(SELECT visit_id, min(mechanic_id) AS lead FROM bookings WHERE mechanic_id IS NOT NULL GROUP BY visit_id)"


@register("apply_new_bookings", f"""
WITH req0 AS (
  SELECT {NUM.format(c='b.id')} AS request_seq, b.customer_id AS who, b.service_id, b.vehicle_id,
    CASE WHEN {NUM.format(c='b.id')} % 13 <> 5 THEN CAST(b.booking_date + INTERVAL 30 DAY AS DATE) END AS booking_date,
    b.start_min, 'follow-up' AS notes,
    p.payment_method, p.is_down_payment, p.down_payment_percent, p.down_payment_amount
  FROM bookings b LEFT JOIN payments p ON b.visit_id = p.visit_id),
req AS (
  SELECT req0.*, CASE WHEN request_seq % 10 = 3 THEN 'staff' WHEN request_seq % 50 = 7 THEN 'mechanic' ELSE 'customer' END AS role,
    CASE WHEN request_seq % 10 = 3
           THEN CASE WHEN request_seq % 200 = 33 THEN NULL WHEN request_seq % 20 = 13 THEN greatest(who - 1, 1) ELSE who END
         WHEN request_seq % 50 = 7 THEN NULL ELSE who END AS cust
  FROM req0),
r AS (SELECT req.*, s.id AS sid, s.in_stock, s.price, v.id AS vid, v.customer_id AS owner,
        coalesce(req.service_id, 0) = 0 OR coalesce(req.vehicle_id, 0) = 0 OR req.booking_date IS NULL OR req.start_min IS NULL AS missing
      FROM req LEFT JOIN services s ON req.service_id = s.id LEFT JOIN vehicles v ON req.vehicle_id = v.id),
t AS (SELECT r.*, NOT missing AND sid IS NOT NULL AND coalesce(in_stock, false) AND vid IS NOT NULL
        AND (role = 'customer' OR (role = 'staff' AND coalesce(cust, 0) <> 0)) AS part FROM r),
o AS (SELECT t.*,
        last_value(CASE WHEN part AND role = 'staff' THEN cust END IGNORE NULLS) OVER w AS staff_owner,
        first_value(CASE WHEN part AND role = 'customer' THEN cust END IGNORE NULLS) OVER w AS adopter
      FROM t WINDOW w AS (PARTITION BY vehicle_id ORDER BY request_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
n AS (SELECT o.*, coalesce(staff_owner, owner, adopter, CASE WHEN part THEN cust END) AS owner_now FROM o),
chk AS (SELECT n.*,
  CASE WHEN missing THEN 'Service, vehicle, date and time are required'
       WHEN sid IS NULL THEN 'Service not found'
       WHEN NOT in_stock THEN 'Service is currently unavailable'
       WHEN role NOT IN ('customer', 'staff') THEN 'Not authorized to create bookings'
       WHEN role = 'staff' AND coalesce(cust, 0) = 0 THEN 'Customer ID is required for admin/staff booking creation'
       WHEN vid IS NULL THEN 'Vehicle not found'
       WHEN role = 'customer' AND coalesce(owner_now <> cust, false) THEN 'Vehicle does not belong to this customer' END
    AS reject_reason
  FROM n),
top AS (SELECT max(TRY_CAST(regexp_extract(id, '^B-(\\d+)$', 1) AS BIGINT)) AS t FROM bookings)
SELECT request_seq, cust AS customer_id, service_id, vehicle_id, CAST(booking_date AS VARCHAR) AS booking_date,
  start_min, notes, CAST(NULL AS BIGINT) AS mechanic_id, CAST(NULL AS VARCHAR) AS customer_name,
  CAST(price AS DOUBLE) AS total_price, payment_method, coalesce(is_down_payment, false) AS is_down_payment,
  CASE WHEN is_down_payment THEN down_payment_percent ELSE 0 END AS down_payment_percent,
  CAST(CASE WHEN is_down_payment THEN down_payment_amount ELSE 0 END AS DOUBLE) AS down_payment_amount,
  CASE WHEN vid IS NOT NULL THEN CASE WHEN role = 'staff' AND part THEN cust ELSE owner_now END END AS vehicle_owner_after, reject_reason,
  CASE WHEN reject_reason IS NULL THEN concat('B-', CAST((SELECT t FROM top)
       + row_number() OVER (PARTITION BY reject_reason IS NULL ORDER BY request_seq) AS VARCHAR)) END AS id,
  CASE WHEN reject_reason IS NULL THEN 'pending' END AS status,
  CASE WHEN reject_reason IS NULL AND payment_method IS NOT NULL THEN 'pending' END AS payment_status
FROM chk""")
def q_apply_new_bookings(g):
    """M1 + M14 + E12: follow-up booking requests of all jobs, by customers and staff, checked (JS-falsy fields, boolean coercion), numbered B-<n>, with pending payments."""
    return M.apply_new_bookings(g, SI.new_booking_requests(g))


M2_TS = f"{AS_OF} 17:00:00"


@register("apply_status_changes", f"""
WITH ch AS (
  SELECT id AS change_seq, booking_id, status AS new_status, 'mechanic' AS actor_role, mechanic_id AS actor_mechanic_id
  FROM mechanic_tasks
  UNION ALL
  SELECT 2 * {BIG} + id, booking_id, 'in-progress', 'mechanic', mechanic_id FROM mechanic_tasks WHERE status = 'completed'
  UNION ALL
  SELECT {BIG} + {NUM.format(c='b.id')}, b.id, 'completed', 'mechanic', l.lead
  FROM bookings b JOIN {LEAD_SQL} l ON b.visit_id = l.visit_id WHERE b.status = 'in-progress'),
c AS (SELECT ch.*, b.status AS old_status,
  CASE WHEN b.id IS NULL THEN 'Booking not found'
       WHEN actor_role IN ('admin', 'staff') AND NOT coalesce(new_status IN
         ('pending', 'confirmed', 'in-progress', 'completed', 'cancelled'), false) THEN 'Valid status is required'
       WHEN actor_role = 'mechanic' AND b.mechanic_id IS DISTINCT FROM actor_mechanic_id
         THEN 'Not authorized to update this booking'
       WHEN actor_role = 'mechanic' AND NOT coalesce(new_status IN ('in-progress', 'completed'), false)
         THEN 'Valid status is required. Mechanics can only set in-progress or completed status.'
       WHEN actor_role IS NULL OR actor_role NOT IN ('admin', 'staff', 'mechanic')
         THEN 'Not authorized to update booking status' END AS reject_reason
  FROM ch LEFT JOIN bookings b ON ch.booking_id = b.id),
l AS (SELECT booking_id, max(change_seq) AS last, bool_or(new_status = 'completed') AS done FROM c
      WHERE reject_reason IS NULL GROUP BY booking_id)
SELECT c.change_seq, c.booking_id, c.actor_role, c.actor_mechanic_id, c.old_status, c.new_status, c.reject_reason,
  CASE WHEN c.reject_reason IS NULL AND (c.new_status = 'completed' OR l.done) THEN '{M2_TS}' END AS completed_at,
  l.last IS NOT NULL AS is_final
FROM c LEFT JOIN l ON c.booking_id = l.booking_id AND c.change_seq = l.last""")
def q_apply_status_changes(g):
    """M2: mechanics' status reports checked by role rules; last accepted change per booking marked."""
    return M.apply_status_changes(g, SI.status_change_set(g), M2_TS)


@register("apply_cancellations", f"""
WITH r0 AS (SELECT {NUM.format(c='b.id')} AS request_seq, b.id AS booking_id, b.customer_id, c.user_id, b.status
            FROM bookings b JOIN customers c ON b.customer_id = c.id),
req AS (SELECT request_seq, booking_id, customer_id, user_id FROM r0
        UNION ALL SELECT request_seq + {BIG}, booking_id, customer_id, user_id FROM r0 WHERE status = 'pending'),
c AS (SELECT req.*, b.status AS old_status,
        CASE WHEN b.id IS NULL THEN 'Booking not found or not owned by you'
             WHEN NOT coalesce(b.status IN ('pending', 'confirmed'), false)
               THEN 'Only pending or confirmed bookings can be cancelled' END AS r
      FROM req LEFT JOIN bookings b ON req.booking_id = b.id AND req.customer_id = b.customer_id),
f AS (SELECT booking_id, min(request_seq) AS first FROM c WHERE r IS NULL GROUP BY booking_id),
x AS (SELECT c.*, coalesce(c.r, CASE WHEN c.request_seq <> f.first
                                     THEN 'Only pending or confirmed bookings can be cancelled' END) AS reject_reason
      FROM c LEFT JOIN f ON c.booking_id = f.booking_id)
SELECT request_seq, booking_id, customer_id, user_id, old_status, reject_reason,
  CASE WHEN reject_reason IS NULL THEN 'cancel_booking' END AS audit_action,
  CASE WHEN reject_reason IS NULL THEN 'bookings' END AS audit_table,
  CASE WHEN reject_reason IS NULL THEN concat('{{"status":"', old_status, '"}}') END AS old_values,
  CASE WHEN reject_reason IS NULL THEN '{{"status":"cancelled"}}' END AS new_values
FROM x""")
def q_apply_cancellations(g):
    """M3 + E13: customers cancel their bookings (pending ones twice); audit JSON for accepted ones."""
    return M.apply_cancellations(g, SI.cancellation_requests(g))


@register("apply_task_status", f"""
WITH ch AS (
  SELECT {NUM.format(c='id')} AS change_seq, id AS ref, mechanic_id, 'in-progress' AS status, start_min + 5 AS now_min
  FROM bookings WHERE status = 'confirmed'
  UNION ALL
  SELECT {BIG} + id, CAST(id AS VARCHAR), mechanic_id, 'completed', start_min + 60 FROM mechanic_tasks
  WHERE status = 'in-progress'
  UNION ALL
  SELECT 2 * {BIG} + {NUM.format(c='id')}, id, mechanic_id, 'completed', start_min + 50
  FROM bookings WHERE status = 'confirmed'),
c AS (SELECT ch.*, b.id AS bid, b.start_min AS bstart, t.id AS tid, t.start_min AS ts, t.end_min AS te
      FROM ch LEFT JOIN bookings b ON ch.ref = b.id AND ch.mechanic_id = b.mechanic_id
      LEFT JOIN mechanic_tasks t ON b.id = t.booking_id AND ch.mechanic_id = t.mechanic_id),
x AS (SELECT c.*, bt.id AS xt, bt.booking_id AS xb, bt.start_min AS xs, bt.end_min AS xe
      FROM c LEFT JOIN (SELECT t.*, b2.mechanic_id AS bm2 FROM mechanic_tasks t JOIN bookings b2 ON t.booking_id = b2.id) bt
        ON c.bid IS NULL AND c.ref = CAST(bt.id AS VARCHAR) AND c.mechanic_id = bt.bm2),
y AS (SELECT x.*,
  CASE WHEN NOT coalesce(status IN ('pending', 'in-progress', 'completed'), false)
         THEN 'Valid status is required (pending, in-progress, completed)'
       WHEN bid IS NULL AND xt IS NULL THEN 'Task or booking not found or not assigned to you' END AS reject_reason,
  bid IS NOT NULL AND tid IS NULL AS fresh FROM x),
z AS (SELECT y.*, first_value(change_seq) OVER w AS first_seq, first_value(now_min) OVER w AS first_now FROM y
      WINDOW w AS (PARTITION BY reject_reason IS NULL, coalesce(CAST(coalesce(tid, xt) AS VARCHAR), concat(bid, ' ', mechanic_id))
                   ORDER BY change_seq)),
-- a new task starts at its first change and ends at the booking's start; an existing one is changed at most once here
v AS (SELECT z.*, CASE WHEN fresh THEN first_now WHEN bid IS NOT NULL THEN ts ELSE xs END AS s0,
        CASE WHEN fresh THEN bstart WHEN bid IS NOT NULL THEN te ELSE xe END AS e0 FROM z)
SELECT change_seq, ref, mechanic_id, status, reject_reason,
  CASE WHEN reject_reason IS NULL THEN CASE WHEN bid IS NOT NULL THEN tid ELSE xt END END AS task_id,
  CASE WHEN reject_reason IS NULL THEN CASE WHEN bid IS NOT NULL THEN bid ELSE xb END END AS booking_id,
  CASE WHEN reject_reason IS NULL THEN fresh AND change_seq = first_seq END AS task_created,
  CASE WHEN reject_reason IS NULL THEN CASE WHEN status = 'in-progress' AND (s0 IS NULL OR s0 = e0) THEN now_min
                                            ELSE s0 END END AS start_min,
  CASE WHEN reject_reason IS NULL THEN CASE WHEN status = 'completed' AND e0 IS NULL THEN now_min ELSE e0 END END AS end_min,
  CASE WHEN reject_reason IS NULL THEN CASE WHEN status IN ('in-progress', 'completed') THEN status END END AS booking_status,
  CASE WHEN reject_reason IS NULL AND status = 'completed' THEN now_min END AS completed_min
FROM v""")
def q_apply_task_status(g):
    """M5 + J11: mechanics start confirmed jobs by booking id and finish tasks by task id."""
    return M.apply_task_status(g, SI.task_status_changes(g)).drop("change_no", "task_key")


@register("apply_payment_decisions", """
WITH d AS (SELECT id AS decision_seq, id AS payment_id, CASE WHEN is_down_payment THEN 'approve' ELSE 'reject' END AS decision,
             CASE WHEN NOT is_down_payment THEN 'no down payment' END AS admin_notes
           FROM payments WHERE payment_status = 'pending'),
x AS (SELECT d.*, p.booking_id, p.payment_status AS old_status,
        CASE WHEN p.id IS NULL THEN 'Payment not found'
             WHEN NOT coalesce(d.decision IN ('approve', 'reject'), false) THEN 'Unknown decision' END AS reject_reason
      FROM d LEFT JOIN payments p ON d.payment_id = p.id),
l AS (SELECT payment_id, max(decision_seq) AS last FROM x WHERE reject_reason IS NULL GROUP BY payment_id)
SELECT x.decision_seq, x.payment_id, x.booking_id, x.old_status, x.decision, x.reject_reason,
  CASE WHEN x.reject_reason IS NULL THEN CASE WHEN x.decision = 'approve' THEN 'approved' ELSE 'rejected' END END
    AS new_payment_status,
  CASE WHEN x.reject_reason IS NULL THEN coalesce(x.admin_notes, '') END AS admin_notes,
  CASE WHEN x.reject_reason IS NULL AND x.decision = 'approve' THEN 'confirmed' END AS booking_status,
  l.last IS NOT NULL AS is_final
FROM x LEFT JOIN l ON x.payment_id = l.payment_id AND x.decision_seq = l.last""")
def q_apply_payment_decisions(g):
    """M6: pending payments approved (down payment made) or rejected."""
    return M.apply_payment_decisions(g, SI.payment_decisions(g))


@register("apply_testimonials", f"""
WITH s0 AS (SELECT {NUM.format(c='id')} AS submission_seq, customer_id, service_id, mechanic_id, rating,
              concat('Review of ', id) AS comment FROM bookings WHERE status = 'completed' AND rating IS NOT NULL),
x AS (SELECT s0.*,
  CASE WHEN coalesce(s0.service_id, 0) = 0 OR s0.rating IS NULL OR s0.rating = 0 OR s0.comment IS NULL OR s0.comment = ''
         THEN 'Service ID, rating, and comment are required'
       WHEN s0.rating < 1 OR s0.rating > 5 THEN 'Rating must be between 1 and 5'
       WHEN sv.id IS NULL THEN 'Service not found'
       WHEN s0.mechanic_id IS NOT NULL AND m.id IS NULL THEN 'Mechanic not found'
       WHEN EXISTS (SELECT 1 FROM testimonials t WHERE t.customer_id = s0.customer_id AND t.service_id = s0.service_id
                    AND t.mechanic_id IS NOT DISTINCT FROM s0.mechanic_id)
         THEN 'You have already submitted a testimonial for this service/mechanic combination' END AS r
  FROM s0 LEFT JOIN services sv ON s0.service_id = sv.id LEFT JOIN mechanics m ON s0.mechanic_id = m.id),
f AS (SELECT customer_id, service_id, mechanic_id, min(submission_seq) AS first FROM x WHERE r IS NULL
      GROUP BY customer_id, service_id, mechanic_id),
y AS (SELECT x.*, coalesce(x.r, CASE WHEN x.submission_seq <> f.first
        THEN 'You have already submitted a testimonial for this service/mechanic combination' END) AS reject_reason
      FROM x LEFT JOIN f ON x.customer_id = f.customer_id AND x.service_id = f.service_id
        AND x.mechanic_id IS NOT DISTINCT FROM f.mechanic_id)
SELECT submission_seq, customer_id, service_id, mechanic_id, rating, comment, reject_reason,
  CASE WHEN reject_reason IS NULL THEN '{AS_OF}' END AS date,
  CASE WHEN reject_reason IS NULL THEN false END AS approved, CASE WHEN reject_reason IS NULL THEN false END AS featured
FROM y""")
def q_apply_testimonials(g):
    """M7 + P11: reviews of rated jobs; NULL-safe duplicates (stored or earlier in batch) refused."""
    return M.apply_testimonials(g, SI.testimonial_submissions(g), AS_OF)


@register("moderate_testimonials", """
WITH a AS (
  SELECT id * 2 AS action_seq, id AS testimonial_id, 'approve' AS action, true AS value FROM testimonials
  WHERE NOT approved AND rating >= 4
  UNION ALL SELECT id * 2 + 1, id, 'feature', true FROM testimonials WHERE NOT approved AND rating >= 4
  UNION ALL SELECT id * 2, id, 'feature', true FROM testimonials WHERE NOT approved AND rating < 4
  UNION ALL SELECT id * 2, id, 'feature', rating >= 4 FROM testimonials WHERE approved),
x AS (SELECT a.*, t.id AS tid, t.approved AS a0,
        last_value(CASE WHEN action = 'approve' THEN value END IGNORE NULLS) OVER (PARTITION BY testimonial_id
          ORDER BY action_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ab
      FROM a LEFT JOIN testimonials t ON a.testimonial_id = t.id),
y AS (SELECT x.*, coalesce(ab, a0) AS before,
        CASE WHEN tid IS NULL THEN 'Testimonial not found'
             WHEN action = 'feature' AND value AND NOT coalesce(ab, a0) THEN 'Cannot feature an unapproved testimonial'
        END AS reject_reason FROM x)
SELECT action_seq, testimonial_id, action, value, reject_reason,
  CASE WHEN reject_reason IS NULL THEN CASE WHEN action = 'approve' THEN value ELSE before END END AS approved_after,
  CASE WHEN reject_reason IS NULL THEN CASE WHEN action = 'approve' THEN false ELSE value END END AS featured_after
FROM y""")
def q_moderate_testimonials(g):
    """M8: approve/feature actions applied in order; featuring needs approval at that moment."""
    return M.moderate_testimonials(g, SI.moderation_actions(g))


@register("partial_update_services", """
SELECT id, name, description, category,
  CAST(CASE WHEN featured THEN CAST(round(price * CAST(1.10 AS DECIMAL(3,2)), 2) AS DECIMAL(12,2)) ELSE price END AS DOUBLE)
    AS price,
  estimated_time, CASE WHEN stock < 3 THEN false ELSE in_stock END AS in_stock, featured,
  CASE WHEN stock < 3 THEN 0 ELSE stock END AS stock
FROM services""")
def q_partial_update_services(g):
    """M9: services patched field by field (price rise, stock-out) as a new table version."""
    return M.partial_update(g.services, SI.service_patches(g))


@register("replace_availability", """
WITH ns AS (SELECT mechanic_id, day_of_week, start_min + 60 AS start_min, end_min + 60 AS end_min FROM mechanic_availability
            UNION ALL SELECT id, 6, 600, 600 FROM mechanics WHERE experience = 0),
ok AS (SELECT mechanic_id FROM ns GROUP BY mechanic_id
       HAVING bool_and(coalesce(day_of_week BETWEEN 0 AND 6 AND start_min IS NOT NULL AND end_min IS NOT NULL
                                AND start_min < end_min, false)))
SELECT a.mechanic_id, a.day_of_week, a.start_min, a.end_min, false AS replaced FROM mechanic_availability a
WHERE a.mechanic_id NOT IN (SELECT mechanic_id FROM ok)
UNION ALL
SELECT mechanic_id, day_of_week, start_min, end_min, true FROM ns WHERE mechanic_id IN (SELECT mechanic_id FROM ok)""")
def q_replace_availability(g):
    """Weekly availability sets replaced all-or-nothing per mechanic."""
    return M.replace_child_set(g.mechanic_availability, SI.availability_sets(g), "mechanic_id", M.availability_valid())


CASCADE_IDS = """ids AS (SELECT id FROM users WHERE status = 'inactive'),
gc AS (SELECT id FROM customers WHERE user_id IN (SELECT id FROM ids)),
gm AS (SELECT id FROM mechanics WHERE user_id IN (SELECT id FROM ids))"""


def _inactive_users(g):
    from pyspark.sql import functions as F
    return g.users.where(F.col("status") == "inactive").select(F.col("id").alias("user_id"))


@register("cascade_delete_users", f"""
WITH {CASCADE_IDS}
SELECT b.id, b.customer_id, CASE WHEN b.mechanic_id IN (SELECT id FROM gm) THEN NULL ELSE b.mechanic_id END AS mechanic_id,
  b.status
FROM bookings b WHERE b.customer_id NOT IN (SELECT id FROM gc)""")
def q_cascade_delete_users(g):
    """Bookings after deleting every inactive user with the reference's cascade."""
    return M.cascade_delete_users(g, _inactive_users(g)).bookings.select("id", "customer_id", "mechanic_id", "status")


@register("cascade_delete_summary", f"""
WITH {CASCADE_IDS}
SELECT 'testimonials' AS table_name, count(*) AS row_count FROM testimonials WHERE customer_id NOT IN (SELECT id FROM gc)
UNION ALL SELECT 'vehicles', count(*) FROM vehicles WHERE customer_id IS NULL OR customer_id NOT IN (SELECT id FROM gc)
UNION ALL SELECT 'customers', count(*) FROM customers WHERE id NOT IN (SELECT id FROM gc)
UNION ALL SELECT 'mechanics', count(*) FROM mechanics WHERE id NOT IN (SELECT id FROM gm)
UNION ALL SELECT 'users', count(*) FROM users WHERE id NOT IN (SELECT id FROM ids)
{"".join(f"""UNION ALL SELECT '{t}', count(*) FROM {t} WHERE booking_id IS NULL OR booking_id NOT IN
  (SELECT id FROM bookings WHERE customer_id IN (SELECT id FROM gc))
""" for t in ("payments", "mechanic_tasks", "field_notes"))}""")
def q_cascade_delete_summary(g):
    """Row counts of the other cascaded tables after the delete."""
    from functools import reduce
    from pyspark.sql import functions as F
    after = M.cascade_delete_users(g, _inactive_users(g))
    parts = [getattr(after, t).agg(F.count("*").alias("row_count")).select(F.lit(t).alias("table_name"), "row_count")
             for t in ("testimonials", "vehicles", "customers", "mechanics", "users", "payments", "mechanic_tasks", "field_notes")]
    return reduce(lambda a, b: a.unionByName(b), parts)


@register("delete_services", """
SELECT id, service_id FROM bookings WHERE service_id NOT IN (SELECT id FROM services WHERE NOT in_stock)""")
def q_delete_services(g):
    """Bookings after deleting the out-of-stock services (cascade)."""
    from pyspark.sql import functions as F
    ids = g.services.where(~F.col("in_stock")).select(F.col("id").alias("service_id"))
    return M.delete_services(g, ids).bookings.select("id", "service_id")


@register("delete_services_children", """
WITH gone AS (SELECT id FROM bookings WHERE service_id IN (SELECT id FROM services WHERE NOT in_stock))
SELECT 'payments' AS table_name, count(*) AS row_count FROM payments WHERE booking_id IS NULL OR booking_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'mechanic_tasks', count(*) FROM mechanic_tasks WHERE booking_id IS NULL OR booking_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'field_notes', count(*) FROM field_notes WHERE booking_id IS NULL OR booking_id NOT IN (SELECT id FROM gone)""")
def q_delete_services_children(g):
    """Rows left of the tables below bookings after deleting the out-of-stock services."""
    from functools import reduce
    from pyspark.sql import functions as F
    ids = g.services.where(~F.col("in_stock")).select(F.col("id").alias("service_id"))
    after = M.delete_services(g, ids)
    parts = [getattr(after, t).agg(F.count("*").alias("row_count")).select(F.lit(t).alias("table_name"), "row_count")
             for t in ("payments", "mechanic_tasks", "field_notes")]
    return reduce(lambda a, b: a.unionByName(b), parts)


@register("delete_vehicles", """
SELECT v.id AS vehicle_id,
  CASE WHEN v.id IN (SELECT vehicle_id FROM bookings) THEN 'Cannot delete vehicle that is used in bookings' END AS reject_reason,
  v.id NOT IN (SELECT vehicle_id FROM bookings) AS deleted
FROM vehicles v WHERE v.customer_id IS NULL""")
def q_delete_vehicles(g):
    """Deleting the owner-less vehicles, refused while bookings use them."""
    from pyspark.sql import functions as F
    ids = g.vehicles.where(F.col("customer_id").isNull()).select(F.col("id").alias("vehicle_id"))
    return M.delete_vehicles(g, ids)


@register("fill_unowned_vehicles", """
WITH f AS (SELECT c.id FROM customers c JOIN users u ON c.user_id = u.id ORDER BY u.name, c.id LIMIT 1)
SELECT v.id, coalesce(v.customer_id, (SELECT id FROM f)) AS customer_id, v.make, v.model, v.year, v.license_plate,
  v.vin, v.color FROM vehicles v""")
def q_fill_unowned_vehicles(g):
    """Owner-less vehicles given to the first customer by name."""
    return M.fill_unowned_vehicles(g)


@register("append_field_notes", f"""
WITH n AS (
  SELECT mt.id AS note_seq, mt.booking_id, mt.mechanic_id, concat('progress ', CAST(mt.id AS VARCHAR)) AS note,
    b.booking_date AS date FROM mechanic_tasks mt JOIN bookings b ON mt.booking_id = b.id
  UNION ALL
  SELECT {BIG} + {NUM.format(c='b.id')}, b.id, l.lead, 'lead check', b.booking_date
  FROM bookings b JOIN {LEAD_SQL} l ON b.visit_id = l.visit_id),
x AS (SELECT n.*, CASE WHEN n.booking_id IS NULL OR n.booking_id = '' OR n.note IS NULL OR n.note = ''
                         THEN 'Booking ID and note are required'
                       WHEN b.id IS NULL THEN 'Booking not found or not assigned to you' END AS reject_reason
      FROM n LEFT JOIN bookings b ON n.booking_id = b.id AND n.mechanic_id = b.mechanic_id),
nw AS (SELECT booking_id, first(note ORDER BY date DESC, note_seq DESC) AS booking_note_after FROM x
       WHERE reject_reason IS NULL GROUP BY booking_id)
SELECT x.note_seq, x.booking_id, x.mechanic_id, x.note, CAST(x.date AS VARCHAR) AS date, x.reject_reason,
  CASE WHEN x.reject_reason IS NULL THEN 'pending' END AS status, nw.booking_note_after
FROM x LEFT JOIN nw ON x.booking_id = nw.booking_id""")
def q_append_field_notes(g):
    """Field notes accepted only from the assigned mechanic; newest copied to the booking."""
    return M.append_field_notes(g, SI.field_note_appends(g))


@register("provision_users", f"""
WITH rows AS (
  SELECT id AS row_seq, email, name, role, 'general' AS specialization, 1 AS experience, CAST(NULL AS VARCHAR) AS address
  FROM users WHERE role = 'mechanic'
  UNION ALL
  SELECT {BIG} + customer_id, concat('thread', CAST(customer_id AS VARCHAR), '@example.com'),
    concat('Chat Customer ', CAST(customer_id AS VARCHAR)), 'customer', NULL, NULL, 'online'
  FROM (SELECT DISTINCT customer_id FROM customer_messages)
  UNION ALL
  SELECT 2 * {BIG} + id, CASE WHEN id % 2 = 0 THEN concat('new', email) END, name, 'pirate', NULL, NULL, NULL
  FROM users WHERE role = 'customer'
  UNION ALL
  SELECT 3 * {BIG} + id, concat('apprentice.', email), name, role, CASE WHEN id % 2 = 0 THEN 'general' END, 1, NULL
  FROM users WHERE role = 'mechanic'),
x AS (SELECT rows.*, CASE WHEN coalesce(email, '') = '' OR coalesce(name, '') = '' OR coalesce(role, '') = '' THEN 'All fields are required'
                          WHEN role NOT IN ('admin', 'staff', 'mechanic', 'customer', 'owner') THEN 'Invalid role specified'
                          WHEN email IN (SELECT email FROM users) THEN 'Email already in use'
                          WHEN role = 'mechanic' AND (specialization IS NULL OR specialization = '' OR experience IS NULL)
                            THEN 'Specialization and experience are required for mechanics' END AS r FROM rows),
f AS (SELECT email AS e, min(row_seq) AS first FROM x WHERE r IS NULL GROUP BY 1),
y AS (SELECT x.*, coalesce(x.r, CASE WHEN x.row_seq <> f.first THEN 'Email already in use' END) AS reject_reason
      FROM x LEFT JOIN f ON x.email = f.e)
SELECT row_seq, email, name, role, specialization, experience, address, reject_reason,
  CASE WHEN reject_reason IS NULL THEN (SELECT max(id) FROM users)
       + row_number() OVER (PARTITION BY reject_reason IS NULL ORDER BY row_seq) END AS user_id,
  CASE WHEN reject_reason IS NULL THEN {INITIALS_SQL} END AS initials
FROM y""")
def q_provision_users(g):
    """M16 + E1: account rows provisioned unless the e-mail is taken; new ids after the largest."""
    return M.provision_users(g, SI.user_rows(g))


@register("backfill_renamed_columns", "SELECT id, CAST(booking_date AS VARCHAR) AS booking_date FROM bookings")
def q_backfill_renamed_columns(g):
    """Legacy ``date`` values copied into ``booking_date`` where missing, old column dropped."""
    return M.backfill_renamed_columns(SI.legacy_bookings(g), {"date": "booking_date"}).select("id", "booking_date")


# ---------------------------------------------------------------- sinks and stream (S, X)
from wrenchflow.sources import sinks as S  # noqa: E402
from wrenchflow.streaming import activity as X  # noqa: E402


def _run_dir(g, name):
    from wrenchflow.session import scratch_path
    return scratch_path(g.bookings.sparkSession, f"runs/{name}/{_uuid.uuid4().hex}")


@register("refresh_stats_table", REGISTRY["dashboard_stats"].sql)
def q_refresh_stats_table(g):
    """S3: dashboard stats recomputed into a table and read back."""
    return S.refresh_stats_table(A.dashboard_stats(g, AS_OF), _run_dir(g, "dashboard_stats"))


@register("append_report", REGISTRY["generate_report"].sql)
def q_append_report(g):
    """The generated monthly report appended to the reports table; this run's rows read back."""
    return S.append_report(A.generate_report(g, "monthly", "2000-06-15"), _run_dir(g, "reports"))


@register("append_report_empty_period", REGISTRY["generate_report"].sql.replace(M_START, "1950-03-01")
          .replace(M_END, "1950-03-31").replace("2000-06-15", "1950-03-15"))
def q_append_report_empty_period(g):
    """The report of a month without bookings (NULL rating and names) is appended and read back too."""
    return S.append_report(A.generate_report(g, "monthly", "1950-03-15"), _run_dir(g, "reports"))


@register("append_audit_log", "SELECT user_id, audit_action AS action, audit_table AS table_name, booking_id AS record_id, "
          "old_values, new_values FROM (" + REGISTRY["apply_cancellations"].sql + ") WHERE reject_reason IS NULL")
def q_append_audit_log(g):
    """Audit rows of accepted cancellations appended; this run's rows read back."""
    from pyspark.sql import functions as F
    c = M.apply_cancellations(g, SI.cancellation_requests(g)).where(F.col("reject_reason").isNull())
    audit = c.select(F.col("user_id"), F.col("audit_action").alias("action"), F.col("audit_table").alias("table_name"),
                     F.col("booking_id").alias("record_id"), "old_values", "new_values")
    return S.append_audit_log(audit, _run_dir(g, "audit_logs"))


@register("activity_log_stream", """
SELECT user_id, action, detail, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, ip_address
FROM activity_log WHERE ok AND user_id IS NOT NULL""")
def q_activity_log_stream(g):
    """X1 + S5: successful actions of known users through a Structured Streaming append (availableNow)."""
    return X.run_activity_feed(g.activity_log, _run_dir(g, "activity_feed"))


# ---------------------------------------------------------------- remaining section-2 items
@register("bookings_last_30_days", f"""
SELECT id, CAST(booking_date AS VARCHAR) AS booking_date, status FROM bookings
WHERE booking_date >= DATE '{AS_OF}' - INTERVAL 30 DAY""")
def q_bookings_last_30_days(g):
    """Bookings from 30 days before AS_OF on, no upper bound."""
    from wrenchflow.functions.predicates import last_n_days
    return g.bookings.where(last_n_days("booking_date", 30, AS_OF)).select("id", "booking_date", "status")


@register("bookings_year_to_date", f"""
SELECT id, CAST(booking_date AS VARCHAR) AS booking_date, status FROM bookings
WHERE booking_date >= date_trunc('year', DATE '{AS_OF}')""")
def q_bookings_year_to_date(g):
    """Bookings from the start of AS_OF's year."""
    from wrenchflow.functions.predicates import period_to_date
    return g.bookings.where(period_to_date("booking_date", "year", AS_OF)).select("id", "booking_date", "status")


@register("payments_between", f"""
SELECT id, {TS.format(c='payment_date')} AS payment_date, payment_status FROM payments
WHERE payment_date >= DATE '2000-01-01' AND payment_date < DATE '2000-01-31' + INTERVAL 1 DAY""")
def q_payments_between(g):
    """P10 + T13: payments whose timestamp falls on 2000-01-01 .. 2000-01-31, whole last day included."""
    from wrenchflow.functions.predicates import between_dates
    return g.payments.where(between_dates("payment_date", "2000-01-01", "2000-01-31")).select(
        "id", "payment_date", "payment_status")


@register("live_bookings", "SELECT id, status FROM bookings WHERE status NOT IN ('cancelled', 'completed')")
def q_live_bookings(g):
    """Bookings neither cancelled nor completed."""
    from wrenchflow.functions.predicates import exclude_status
    return g.bookings.where(exclude_status("cancelled", "completed")).select("id", "status")


@register("mechanic_daily_tasks", OUTER_SQL.replace(
    "b.notes AS customer_notes",
    "b.notes AS customer_notes, 0 AS part, coalesce((SELECT string_agg(x.note, ', ' ORDER BY x.note, x.id) "
    "FROM field_notes x WHERE x.booking_id = b.id), '') AS field_notes"))
def q_mechanic_daily_tasks(g):
    """J6 daily form + E14: assigned work with task columns and the notes of each booking as text."""
    return J.mechanic_daily_tasks(g)


@register("load_tables_roundtrip", """
SELECT id, visit_id, customer_id, service_id, mechanic_id, vehicle_id, CAST(booking_date AS VARCHAR) AS booking_date,
  start_min, status, CAST(total_price AS DOUBLE) AS total_price FROM bookings""")
def q_load_tables_roundtrip(g):
    """Every table written as Parquet (bookings partitioned by month) and read back with fixed schemas."""
    from wrenchflow.sources.tables import load_tables, write_tables
    path = _run_dir(g, "tables")
    write_tables(g, path)
    b = load_tables(g.bookings.sparkSession, path).bookings
    return b.select("id", "visit_id", "customer_id", "service_id", "mechanic_id", "vehicle_id", "booking_date",
                    "start_min", "status", "total_price")


@register("testimonial_reject_classes", "SELECT reject_reason, count(*) AS row_count, CASE "
          "WHEN reject_reason IS NULL THEN NULL WHEN regexp_matches(reject_reason, 'already|duplicate') THEN 'unique_violation' "
          "WHEN regexp_matches(reject_reason, 'not found|missing') THEN 'foreign_key_violation' "
          "WHEN regexp_matches(reject_reason, 'required|kosong') THEN 'not_null_violation' ELSE 'validation_error' END "
          "AS error_class FROM (" + REGISTRY["apply_testimonials"].sql + ") GROUP BY reject_reason")
def q_testimonial_reject_classes(g):
    """Reject reasons of the review batch with their error class."""
    from pyspark.sql import functions as F
    out = M.apply_testimonials(g, SI.testimonial_submissions(g), AS_OF)
    return (out.groupBy("reject_reason").agg(F.count("*").alias("row_count"))
            .withColumn("error_class", Q.error_class(F.col("reject_reason"))))


@register("testimonial_wall_all", TEST_SQL)
def q_testimonial_wall_all(g):
    """Every testimonial (staff scope) with names."""
    return J.testimonial_wall(g, "all")


# ---------------------------------------------------------------- the other rule sets of D1
def _validate_sql(source: str, rules: list[tuple[str, str, str]]) -> str:
    """Oracle of a rule chain: (field, message, SQL condition under which the row fails)."""
    failed = [(f, m, f"coalesce({cond}, false)") for f, m, cond in rules]
    return ("SELECT id, concat_ws(';', " + ", ".join(f"CASE WHEN {c} THEN '{f}:{m}' END" for f, m, c in failed)
            + ") AS errors_text, " + " + ".join(f"CAST({c} AS INT)" for _, _, c in failed) + f" AS error_count FROM ({source})")


def _validated(df, rules):
    v = Q.validate(df, rules)
    return v.select("id", _render("errors", "field", "message").alias("errors_text"), _F.size("errors").alias("error_count"))


_EMPTY = "({c} IS NULL OR trim(CAST({c} AS VARCHAR)) = '')"
_ID_BAD = "(TRY_CAST({c} AS BIGINT) IS NULL OR {c} < 1)"


@register("validate_users", _validate_sql("""
SELECT u.id, CASE WHEN u.id % 7 <> 3 THEN u.email ELSE 'no mail' END AS email, CASE WHEN u.id % 11 <> 2 THEN u.name ELSE '' END AS name,
  CASE WHEN u.id % 13 <> 4 THEN u.role ELSE 'pirate' END AS role, u.status,
  CASE WHEN u.id % 3 <> 1 THEN m.specialization END AS specialization, CASE WHEN u.id % 5 <> 1 THEN m.experience ELSE -1 END AS experience
FROM users u LEFT JOIN mechanics m ON u.id = m.user_id""", [
    ("email", Q.MSG_EMAIL, r"email IS NULL OR NOT regexp_matches(email, '^[^\s@]+@[^\s@]+\.[^\s@]+$')"),
    ("name", Q.MSG_NAME_EMPTY, _EMPTY.format(c="name")),
    ("name", Q.MSG_NAME_LEN, "name IS NULL OR length(name) NOT BETWEEN 3 AND 100"),
    ("role", Q.MSG_ROLE, "role IS NULL OR role NOT IN ('admin', 'staff', 'mechanic', 'customer')"),
    ("status", Q.MSG_STATUS, "status IS NOT NULL AND status NOT IN ('active', 'inactive', 'on-leave', 'suspended')"),
    ("specialization", Q.MSG_SPECIALIZATION, "role = 'mechanic' AND " + _EMPTY.format(c="specialization")),
    ("experience", Q.MSG_EXPERIENCE, "role = 'mechanic' AND (experience IS NULL OR experience < 0)")]))
def q_validate_users(g):
    """User rule chain over account forms, some with a bad mail, name, role or mechanic field."""
    u, m = g.users, g.mechanics.select("user_id", "specialization", "experience")
    i = _F.col("id")
    df = u.join(m, i == _F.col("user_id"), "left").select(
        "id", _F.when(i % 7 != 3, _F.col("email")).otherwise("no mail").alias("email"),
        _F.when(i % 11 != 2, _F.col("name")).otherwise("").alias("name"),
        _F.when(i % 13 != 4, _F.col("role")).otherwise("pirate").alias("role"), "status",
        _F.when(i % 3 != 1, _F.col("specialization")).alias("specialization"),
        _F.when(i % 5 != 1, _F.col("experience")).otherwise(-1).alias("experience"))
    return _validated(df, Q.user_rules())


@register("validate_services", _validate_sql("""
SELECT id, CASE WHEN id % 11 <> 2 THEN name ELSE 'ab' END AS name, CASE WHEN id % 7 <> 3 THEN price ELSE -1 END AS price,
  CASE WHEN id % 13 <> 4 THEN category ELSE ' ' END AS category, CASE WHEN id % 5 <> 1 THEN estimated_time ELSE 0 END AS estimated_time
FROM services""", [
    ("name", Q.MSG_SERVICE_NAME_EMPTY, _EMPTY.format(c="name")),
    ("name", Q.MSG_SERVICE_NAME_LEN, "name IS NULL OR length(name) NOT BETWEEN 3 AND 100"),
    ("price", Q.MSG_PRICE, "price IS NULL OR price < 0"),
    ("category", Q.MSG_CATEGORY, _EMPTY.format(c="category")),
    ("estimated_time", Q.MSG_ESTIMATE, _ID_BAD.format(c="estimated_time"))]))
def q_validate_services(g):
    """Service rule chain, some forms with a short name, negative price, blank category or zero estimate."""
    i = _F.col("id")
    df = g.services.select(
        "id", _F.when(i % 11 != 2, _F.col("name")).otherwise("ab").alias("name"),
        _F.when(i % 7 != 3, _F.col("price")).otherwise(-1).alias("price"),
        _F.when(i % 13 != 4, _F.col("category")).otherwise(" ").alias("category"),
        _F.when(i % 5 != 1, _F.col("estimated_time")).otherwise(0).alias("estimated_time"))
    return _validated(df, Q.service_rules())


@register("validate_bookings", _validate_sql("""
SELECT CASE WHEN n % 17 <> 3 THEN id ELSE concat('X', id) END AS id, service_id, CASE WHEN n % 7 <> 3 THEN vehicle_id ELSE 0 END AS vehicle_id,
  CASE WHEN n % 11 <> 2 THEN CAST(booking_date AS VARCHAR) ELSE 'soon' END AS booking_date,
  CASE WHEN n % 5 <> 1 THEN printf('%02d:%02d', start_min // 60, start_min % 60) ELSE '25:00' END AS booking_time,
  CASE WHEN n % 13 <> 4 THEN customer_id ELSE -1 END AS customer_id, CASE WHEN n % 19 <> 4 THEN status ELSE 'lost' END AS status
FROM (SELECT *, CAST(substr(id, 3) AS BIGINT) AS n FROM bookings)""", [
    ("service_id", Q.MSG_SERVICE_ID, _ID_BAD.format(c="service_id")),
    ("vehicle_id", Q.MSG_VEHICLE_ID, _ID_BAD.format(c="vehicle_id")),
    ("booking_date", Q.MSG_DATE, "TRY_CAST(booking_date AS DATE) IS NULL"),
    ("booking_time", Q.MSG_TIME, "booking_time IS NULL OR NOT regexp_matches(booking_time, '^([0-1]?[0-9]|2[0-3]):[0-5][0-9]$')"),
    ("customer_id", Q.MSG_CUSTOMER_ID, "customer_id IS NOT NULL AND customer_id < 1"),
    ("status", Q.MSG_STATUS, "status IS NULL OR status NOT IN ('pending', 'confirmed', 'in-progress', 'completed', 'cancelled')"),
    ("id", Q.MSG_BOOKING_ID_FORMAT, r"id IS NULL OR NOT regexp_matches(id, '^B-\d+$')")]))
def q_validate_bookings(g):
    """Booking rule chain, some forms with a bad key, date, time, customer or status."""
    from wrenchflow.functions.exprs import hhmm
    n = _F.substring("id", 3, 40).cast("long")
    df = g.bookings.select(
        _F.when(n % 17 != 3, _F.col("id")).otherwise(_F.concat(_F.lit("X"), "id")).alias("id"), "service_id",
        _F.when(n % 7 != 3, _F.col("vehicle_id")).otherwise(0).alias("vehicle_id"),
        _F.when(n % 11 != 2, _F.col("booking_date").cast("string")).otherwise("soon").alias("booking_date"),
        _F.when(n % 5 != 1, hhmm("start_min")).otherwise("25:00").alias("booking_time"),
        _F.when(n % 13 != 4, _F.col("customer_id")).otherwise(-1).alias("customer_id"),
        _F.when(n % 19 != 4, _F.col("status")).otherwise("lost").alias("status"))
    return _validated(df, Q.booking_rules())


@register("validate_testimonials", _validate_sql("""
SELECT id, service_id, CASE WHEN id % 7 <> 3 THEN mechanic_id ELSE 0 END AS mechanic_id,
  CASE WHEN id % 5 <> 1 THEN rating ELSE 6 END AS rating, CASE WHEN id % 11 <> 2 THEN comment ELSE '  ' END AS comment
FROM testimonials""", [
    ("service_id", Q.MSG_SERVICE_ID, _ID_BAD.format(c="service_id")),
    ("mechanic_id", Q.MSG_MECHANIC_ID, "mechanic_id IS NOT NULL AND mechanic_id < 1"),
    ("rating", Q.MSG_RATING, "rating IS NULL OR rating NOT BETWEEN 1 AND 5"),
    ("comment", Q.MSG_COMMENT, _EMPTY.format(c="comment"))]))
def q_validate_testimonials(g):
    """Testimonial rule chain, some forms with a bad mechanic, rating or comment."""
    i = _F.col("id")
    df = g.testimonials.select(
        "id", "service_id", _F.when(i % 7 != 3, _F.col("mechanic_id")).otherwise(0).alias("mechanic_id"),
        _F.when(i % 5 != 1, _F.col("rating")).otherwise(6).alias("rating"),
        _F.when(i % 11 != 2, _F.col("comment")).otherwise("  ").alias("comment"))
    return _validated(df, Q.testimonial_rules())


@register("validate_field_notes", _validate_sql("""
SELECT id, CASE WHEN id % 7 <> 3 THEN booking_id ELSE '' END AS booking_id, CASE WHEN id % 5 <> 1 THEN note END AS note,
  CASE WHEN id % 11 <> 2 THEN status ELSE 'lost' END AS status FROM field_notes""", [
    ("booking_id", Q.MSG_BOOKING_ID_EMPTY, _EMPTY.format(c="booking_id")),
    ("note", Q.MSG_NOTE_EMPTY, _EMPTY.format(c="note")),
    ("status", Q.MSG_STATUS, "status IS NOT NULL AND status NOT IN ('pending', 'in-progress', 'completed', 'cancelled')")]))
def q_validate_field_notes(g):
    """Field note rule chain, some forms without booking or note or with a bad status."""
    i = _F.col("id")
    df = g.field_notes.select(
        "id", _F.when(i % 7 != 3, _F.col("booking_id")).otherwise("").alias("booking_id"),
        _F.when(i % 5 != 1, _F.col("note")).alias("note"),
        _F.when(i % 11 != 2, _F.col("status")).otherwise("lost").alias("status"))
    return _validated(df, Q.field_note_rules())


@register("validate_messages", _validate_sql("""
SELECT customer_id * 100000 + turn AS id, CASE WHEN turn % 3 <> 1 THEN message ELSE ' ' END AS message FROM customer_messages""", [
    ("message", Q.MSG_MESSAGE, _EMPTY.format(c="message"))]))
def q_validate_messages(g):
    """Message rule, some messages blank."""
    df = g.customer_messages.select((_F.col("customer_id") * 100000 + _F.col("turn")).alias("id"),
                                    _F.when(_F.col("turn") % 3 != 1, _F.col("message")).otherwise(" ").alias("message"))
    return _validated(df, Q.message_rules())


@register("apply_messages", f"""
WITH sent AS (
  SELECT {NUM.format(c='id')} AS message_seq, CASE {NUM.format(c='id')} % 5 WHEN 0 THEN 'staff' WHEN 1 THEN 'mechanic' ELSE 'customer' END AS role,
    CASE WHEN {NUM.format(c='id')} % 11 <> 3 THEN customer_id ELSE -7 END AS customer_id, id AS booking_id,
    CASE WHEN {NUM.format(c='id')} % 7 <> 2 THEN concat('about ', id) ELSE '' END AS message
  FROM bookings WHERE status IN ('pending', 'in-progress')),
x AS (SELECT sent.*, CASE WHEN role NOT IN ('customer', 'admin', 'staff') THEN 'forbidden' WHEN message = '' THEN 'missing fields'
        WHEN role = 'customer' AND NOT EXISTS (SELECT 1 FROM bookings b WHERE b.id = booking_id AND b.customer_id = sent.customer_id) THEN 'not found'
        WHEN role = 'staff' AND sent.customer_id NOT IN (SELECT id FROM customers) THEN 'not found' END AS reject_reason FROM sent)
SELECT message_seq, role, customer_id, booking_id, message, reject_reason,
  CASE WHEN reject_reason IS NULL THEN CASE WHEN role = 'customer' THEN 'incoming' ELSE 'outgoing' END END AS type,
  CASE WHEN reject_reason IS NULL THEN coalesce((SELECT max(turn) FROM customer_messages m WHERE m.customer_id = x.customer_id), 0)
    + row_number() OVER (PARTITION BY customer_id, reject_reason IS NULL ORDER BY message_seq) END AS turn,
  CASE WHEN reject_reason IS NULL THEN false END AS is_read
FROM x""")
def q_apply_messages(g):
    """Messages about open bookings sent by customers and staff; some without text, customer or right."""
    n = _F.substring("id", 3, 40).cast("long")
    sent = g.bookings.where(_F.col("status").isin("pending", "in-progress")).select(
        n.alias("message_seq"), _F.when(n % 5 == 0, "staff").when(n % 5 == 1, "mechanic").otherwise("customer").alias("role"),
        _F.when(n % 11 != 3, _F.col("customer_id")).otherwise(-7).alias("customer_id"), _F.col("id").alias("booking_id"),
        _F.when(n % 7 != 2, _F.concat(_F.lit("about "), "id")).otherwise("").alias("message"))
    return G.apply_messages(g, sent)


@register("delete_schedules", """
WITH ids AS (SELECT id AS booking_id FROM bookings WHERE status = 'cancelled'
             UNION ALL SELECT concat('X', id) FROM bookings WHERE status = 'pending')
SELECT booking_id, CASE WHEN booking_id NOT IN (SELECT id FROM bookings) THEN 'Booking schedule not found' END AS reject_reason,
  booking_id IN (SELECT id FROM bookings) AS deleted FROM ids""")
def q_delete_schedules(g):
    """Cancelled bookings deleted by id; unknown ids refused."""
    return M.delete_schedules(g, _schedule_ids(g))[0]


@register("delete_schedules_left", """
WITH gone AS (SELECT id FROM bookings WHERE status = 'cancelled')
SELECT 'bookings' AS table_name, count(*) AS row_count FROM bookings WHERE id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'payments', count(*) FROM payments WHERE booking_id IS NULL OR booking_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'mechanic_tasks', count(*) FROM mechanic_tasks WHERE booking_id IS NULL OR booking_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'field_notes', count(*) FROM field_notes WHERE booking_id IS NULL OR booking_id NOT IN (SELECT id FROM gone)""")
def q_delete_schedules_left(g):
    """Rows left of bookings and the tables below them after the cancelled ones are deleted."""
    from functools import reduce
    after = M.delete_schedules(g, _schedule_ids(g))[1]
    parts = [getattr(after, t).agg(_F.count("*").alias("row_count")).select(_F.lit(t).alias("table_name"), "row_count")
             for t in ("bookings", "payments", "mechanic_tasks", "field_notes")]
    return reduce(lambda a, b: a.unionByName(b), parts)


def _schedule_ids(g):
    """Stand-in ids: every cancelled booking, and ids that no booking has."""
    b = g.bookings
    return b.where(_F.col("status") == "cancelled").select(_F.col("id").alias("booking_id")).unionByName(
        b.where(_F.col("status") == "pending").select(_F.concat(_F.lit("X"), "id").alias("booking_id")))


@register("related_documents", """
WITH bs AS (SELECT b.id, b.customer_id, b.booking_date, b.start_min, b.vehicle_id, b.service_id, s.name, s.price
            FROM bookings b JOIN services s ON b.service_id = s.id),
grp AS (SELECT customer_id, booking_date, start_min, vehicle_id, min(id) AS first_booking_id FROM bs GROUP BY 1, 2, 3, 4 HAVING count(*) > 1)
SELECT grp.first_booking_id, 0 AS part, count(*) AS siblings_count, string_agg(concat_ws(':', bs.id, CAST(bs.service_id AS VARCHAR), bs.name,
    CAST(bs.price AS VARCHAR)), ';' ORDER BY bs.id) AS siblings_text
FROM bs JOIN grp ON bs.customer_id = grp.customer_id AND bs.booking_date = grp.booking_date AND bs.start_min = grp.start_min
  AND bs.vehicle_id = grp.vehicle_id GROUP BY grp.first_booking_id""")
def q_related_documents(g):
    """Sibling ids, service names and prices of bookings made together, one document per group."""
    return J.related_documents(g).select("first_booking_id", "part", _F.size("siblings").cast("long").alias("siblings_count"),
                                         _render("siblings", "id", "service_id", "service_name", "service_price").alias("siblings_text"))
