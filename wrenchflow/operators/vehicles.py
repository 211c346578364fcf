"""New vehicles with unique plates and VINs (U2), in a batch and against the stored ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrenchflow import session
from wrenchflow.operators.changes import first_reason, is_falsy, number_rows
from wrenchflow.operators.ordered import first_come, hot_keys, joined_by, looked_up
from wrenchflow.session import dropped, partitions_for, stored
from wrenchflow.sources.tables import Garage

# --- fixed values: reject messages of the reference ----------------------
R_VEHICLE_REQUIRED = "Make, model, year, and license plate are required"
R_VEHICLE_CUSTOMER = "Customer ID is required for admin/staff"
R_VEHICLE_ROLE = "Not authorized to create vehicles"
R_PLATE_TAKEN = "License plate is already registered"
R_VIN_TAKEN = "VIN is already registered"
# ---------------------------------------------------------------------------


def apply_new_vehicles(g: Garage, requests: DataFrame) -> DataFrame:
    """(request_seq, role, requester_customer_id, customer_id, make, model, year, license_plate, vin, color).

    Requests are taken in ``request_seq`` order (ties: plate, VIN, customer).  Checks in the
    reference's order: required fields, the caller's role, the plate, then the VIN if
    one is given, against stored vehicles and those that earlier requests of the batch
    registered: a refused request takes neither plate nor VIN, so a later one may have them.
    Accepted rows get an id after the largest stored one.
    """
    office = F.col("role").isin("admin", "staff")
    owner = F.when(F.col("role") == "customer", F.col("requester_customer_id")).when(office, F.col("customer_id"))
    missing = is_falsy(F.col("make")) | is_falsy(F.col("model")) | is_falsy(F.col("year")) | is_falsy(F.col("license_plate"))
    # messages move as their numbers
    reasons = [R_VEHICLE_REQUIRED, R_VEHICLE_CUSTOMER, R_VEHICLE_ROLE, R_PLATE_TAKEN, R_VIN_TAKEN]
    told = first_reason(*[(F.col("_why") == i, message) for i, message in enumerate(reasons, 1)])
    faulty = first_reason((missing, 1), (office & is_falsy(F.col("customer_id")), 2),
                          (~F.coalesce(office | (F.col("role") == "customer"), F.lit(False)), 3))
    # whole requests are stored in their order, under a number that goes up with it; all checks move only the keys, each of
    # them those of the requests that are still open, and the outcome joins the requests in the end
    order = ["request_seq", "license_plate", "vin", "_cust"]
    n = partitions_for(requests.sparkSession, requests.count())
    whole = stored(requests.select("request_seq", owner.alias("_cust"), "make", "model", "year", "license_plate", "vin", "color",
                                   faulty.cast("byte").alias("_why"))
                   .repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id()))
    r = whole.where("_why is null").select("_row", "license_plate", F.when(~is_falsy(F.col("vin")), F.col("vin")).alias("_vin"))
    large = r.count() > session.TASK_ROWS
    # a plate or VIN (or none) that many ask for lies in many tasks
    hot_plates, hot_vins = (hot_keys(r, "license_plate"), hot_keys(r, "_vin")) if large else (None, None)
    plates = g.vehicles.where("license_plate is not null").select(F.col("license_plate").alias("_p")).distinct()
    vins = g.vehicles.where("vin is not null").select(F.col("vin").alias("_v")).distinct()
    by_plate = stored(looked_up(r, "_row", "license_plate", plates, "_p", hot_plates).select(
        "_row", "license_plate", "_vin", F.when(F.col("_p").isNotNull(), 4).cast("byte").alias("_why")))
    free = by_plate.where("_why is null").drop("_why")
    by_vin = stored(looked_up(free, "_row", "_vin", vins, "_v", hot_vins).select(
        "_row", "license_plate", "_vin", F.when(F.col("_v").isNotNull(), 5).cast("byte").alias("_why")))
    chosen = first_come(by_vin.where("_why is null"), "_row", ["license_plate", "_vin"], keep=["license_plate"], fixed=True)
    # the plate is asked first: also a row with a stored VIN fails by the plate that an accepted earlier row holds
    taken = chosen.where("accepted and license_plate is not null").select(F.col("license_plate").alias("_tp"), F.col("_row").alias("_by"))
    lost = chosen.where("not accepted").select("_row", "license_plate").unionByName(by_vin.where("_why = 5").select("_row", "license_plate"))
    met = looked_up(lost, "_row", "license_plate", taken, "_tp", hot_plates)
    refused = met.select("_row", F.when(F.col("_by") < F.col("_row"), 4).otherwise(5).cast("byte").alias("_why"))
    closed = [f.where("_why is not null").select("_row", "_why") for f in (whole, by_plate)]
    refused = stored(refused.unionByName(closed[0]).unionByName(closed[1]), instead_of=(by_plate, by_vin))
    top = g.vehicles.select(F.max("id")).scalar()
    new = number_rows(chosen.where("accepted").select("_row"), ["_row"], start=F.coalesce(top, F.lit(0)), out="id", fixed=True)
    dropped(chosen)
    fate = new.withColumn("_why", F.lit(None).cast("byte")).unionByName(refused.withColumn("id", F.lit(None).cast("long")))
    fate = fate.select(F.col("_row").alias("_of"), told.alias("reject_reason"), "id")
    return joined_by(whole.drop("_why"), "_row", fate, "_of").select(
        "request_seq", F.col("_cust").alias("customer_id"), "make", "model", "year", "license_plate", "vin", "color", "reject_reason", "id")


def vehicles_after(g: Garage, applied: DataFrame) -> DataFrame:
    """The stored vehicles and the accepted new ones."""
    return g.vehicles.unionByName(applied.where("reject_reason is null").select(
        *[F.col(c).cast(g.vehicles.schema[c].dataType).alias(c) for c in g.vehicles.columns]))
