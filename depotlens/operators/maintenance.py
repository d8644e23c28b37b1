"""Maintenance plans, their progress, incidents and staff."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depotlens.functions.columns import like_ascii, where_equal
from depotlens.functions.dates import in_days_if_both
from depotlens.functions.numbers import exact_sum, percent, zero_if_null
from depotlens.plans.fanout import check_mode
from depotlens.plans.lookups import lookup
from depotlens.plans.stock import Tables


def _with_warehouse(tables: Tables, df: DataFrame) -> DataFrame:
    return lookup(df, tables["warehouses"], "warehouseId", warehouseName="name", warehouseCode="code")


def maintenance_plans(
    tables: Tables,
    warehouse_id: int | None = None,
    type: str | None = None,
    status: str | None = None,
    priority: str | None = None,
    id: int | None = None,
) -> DataFrame:
    """Plans with their warehouse and cost, earliest first."""
    plans = where_equal(
        tables["maintenance_plans"], warehouseId=warehouse_id, type=type, status=status, priority=priority, id=id
    )
    return (
        _with_warehouse(tables, plans)
        .withColumn("plannedCost", F.col("estimatedCost"))
        .withColumn("totalPlannedCost", zero_if_null(F.col("estimatedCost")))
        .orderBy("plannedDate", "id")
    )


def maintenance_progress(tables: Tables, plan_id: int | None = None) -> DataFrame:
    """Progress entries, newest first."""
    return where_equal(tables["maintenance_progress"], planId=plan_id).orderBy(F.desc("updatedAt"), "id")


def incidents(
    tables: Tables,
    warehouse_id: int | None = None,
    type: str | None = None,
    severity: str | None = None,
    status: str | None = None,
    id: int | None = None,
) -> DataFrame:
    """Incidents with their warehouse, newest first."""
    found = where_equal(
        tables["incidents"], warehouseId=warehouse_id, type=type, severity=severity, status=status, id=id
    )
    return _with_warehouse(tables, found).orderBy(F.desc("reportedAt"), "id")


def staff_workload(
    tables: Tables,
    status: str | None = None,
    specialty: str | None = None,
    id: int | None = None,
    mode: str = "reference",
) -> DataFrame:
    """Staff with the plans and incidents that carry their *name*.

    In reference mode both counts are plans x incidents when a person has both.
    """
    check_mode(mode)
    staff = where_equal(tables["maintenance_staff"], status=status, id=id)
    if specialty:
        staff = staff.filter(like_ascii("specialty", specialty))
    for table, name_column, count in (
        ("maintenance_plans", "responsibleStaff", "assignedPlans"),
        ("incidents", "resolvedBy", "assignedIncidents"),
    ):
        per_name = tables[table].groupBy(F.col(name_column).alias("_name")).agg(F.count("*").alias(count))
        staff = staff.join(per_name, F.col("name") == F.col("_name"), "left").drop("_name")
    staff = staff.fillna(0, subset=["assignedPlans", "assignedIncidents"])
    if mode == "reference":
        plans, solved = F.col("assignedPlans"), F.col("assignedIncidents")
        staff = staff.withColumns(
            {
                "assignedPlans": plans * F.greatest(solved, F.lit(1)),
                "assignedIncidents": solved * F.greatest(plans, F.lit(1)),
            }
        )
    return staff.orderBy("name", "id")


PLAN_COUNTS = {
    "plannedPlans": ("status", "planned"),
    "inProgressPlans": ("status", "in_progress"),
    "completedPlans": ("status", "completed"),
    "cancelledPlans": ("status", "cancelled"),
    "preventivePlans": ("type", "preventive"),
    "correctivePlans": ("type", "corrective"),
    "highPriorityPlans": ("priority", "high"),
    "mediumPriorityPlans": ("priority", "medium"),
    "lowPriorityPlans": ("priority", "low"),
}


def maintenance_stats(
    tables: Tables, start: str | None = None, end: str | None = None, warehouse_id: int | None = None
) -> DataFrame:
    """One row of plan counts, cost, average duration and completion rate."""
    plans = where_equal(tables["maintenance_plans"], warehouseId=warehouse_id)
    stats = in_days_if_both(plans, "plannedDate", start, end).agg(
        F.count("*").alias("totalPlans"),
        *[F.count_if(F.col(c) == v).alias(name) for name, (c, v) in PLAN_COUNTS.items()],
        exact_sum(F.col("estimatedCost")).alias("totalPlannedCost"),
        F.avg("estimatedDuration").alias("averageDuration"),
    )
    return stats.withColumns(
        {
            "averageDuration": zero_if_null(F.round("averageDuration", 1)),
            "completionRate": percent(F.col("completedPlans"), F.col("totalPlans")),
        }
    )
