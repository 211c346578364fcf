"""Property tests: partitions of batches, child counts, idempotence, symmetry."""

from hypothesis import given, settings, HealthCheck
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wrenchflow.sources.tables import Garage
from wrenchflow.operators import changes as M
from wrenchflow.operators import nested as N
from wrenchflow.operators.intervals import overlap_counts, schedule_conflicts
from wrenchflow.plans import standins as SI
from wrenchflow.sources.binding import AS_OF


def test_batches_split_into_accepted_and_rejected(garage):
    """accepted + rejected = input, for every batch operator with a request key."""
    cases = [
        (M.apply_new_bookings(garage, SI.new_booking_requests(garage)), SI.new_booking_requests(garage), "request_seq"),
        (M.apply_status_changes(garage, SI.status_change_set(garage), AS_OF + " 17:00:00"),
         SI.status_change_set(garage), "change_seq"),
        (M.apply_cancellations(garage, SI.cancellation_requests(garage)),
         SI.cancellation_requests(garage), "request_seq"),
        (M.apply_testimonials(garage, SI.testimonial_submissions(garage), AS_OF),
         SI.testimonial_submissions(garage), "submission_seq"),
    ]
    for out, inp, key in cases:
        acc = out.where(F.col("reject_reason").isNull()).count()
        rej = out.where(F.col("reject_reason").isNotNull()).count()
        assert acc + rej == inp.count()
        assert out.select(key).distinct().count() == inp.select(key).distinct().count()


def test_booking_document_child_counts(garage):
    doc = N.booking_document(garage)
    got = doc.select(F.sum(F.size("tasks")).alias("t"), F.sum(F.size("field_notes")).alias("n")).first()
    assert got.t == garage.mechanic_tasks.count()
    assert got.n == garage.field_notes.count()
    assert doc.count() == garage.bookings.count()


def test_status_changes_idempotent(garage):
    changes = SI.status_change_set(garage)
    once = M.bookings_after_status_changes(garage, M.apply_status_changes(garage, changes, AS_OF + " 17:00:00"))
    g2 = Garage(**{**garage.as_dict(), "bookings": once})
    twice = M.bookings_after_status_changes(g2, M.apply_status_changes(g2, changes, AS_OF + " 17:00:00"))
    a = once.select("id", "status").exceptAll(twice.select("id", "status")).count()
    assert a == 0 and once.count() == twice.count()


def test_conflicts_symmetric(garage):
    total = schedule_conflicts(garage).agg(F.sum("conflict_count")).first()[0]
    assert total % 2 == 0


intervals = st.lists(st.tuples(st.integers(1, 3), st.integers(0, 100), st.integers(0, 40)), min_size=1, max_size=40)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(ivs=intervals, probes=intervals)
def test_overlap_counts_property(spark, ivs, probes):
    iv = [(k, s, s + d) for k, s, d in ivs]
    pr = [(i, k, s, s + d) for i, (k, s, d) in enumerate(probes)]
    idf = spark.createDataFrame(iv, "k long, start_min long, end_min long")
    pdf = spark.createDataFrame(pr, "pid long, k long, ps long, pe long")
    got = {r.pid: r.n_overlap for r in overlap_counts(pdf, idf, ["k"], "ps", "pe").collect()}
    for pid, k, ps, pe in pr:
        assert got[pid] == sum(1 for k2, s, e in iv if k2 == k and s < pe and e > ps)
