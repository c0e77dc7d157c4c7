"""Workforce counts and what-if overlays. Source rows are never changed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.ranking import cohort_columns, kth

GROUP_ALIASES = {"Worker_Type": "WORKER_TYPE", "Onshore_Offshore": "TECH_MARKET_TYPE"}


def assignment_count(assignments: DataFrame, keys: Sequence[str], identity: str = "assignment_id") -> DataFrame:
    return assignments.groupBy(*keys).agg(F.countDistinct(identity).alias("assignment_count"))


def group_counts(assignments: DataFrame, group_by: Sequence[str], allowed: Sequence[str], identity: str = "assignment_id", aliases: Mapping[str, str] = GROUP_ALIASES) -> DataFrame:
    """Distinct assignments by one to seven chosen dimensions, in dimension order."""
    columns = [aliases.get(g, g) for g in group_by]
    if not 1 <= len(columns) <= 7 or len(set(columns)) != len(columns) or not set(columns) <= set(allowed):
        raise ValueError("unsupported workforce grouping")
    return assignment_count(assignments, columns, identity).orderBy(*columns)


def rollup_counts(assignments: DataFrame, outer: str, inner: str, identity: str = "assignment_id") -> DataFrame:
    """Counts by two dimensions with the grand total; total rows carry NULL dimensions."""
    counted = assignments.select(outer, inner, identity).distinct().groupBy(outer, inner).agg(F.count("*").alias("assignment_count"))
    total = assignments.agg(F.countDistinct(identity).alias("assignment_count"))
    return counted.unionByName(total, allowMissingColumns=True)


def cohort(df: DataFrame, filters: Mapping[str, str | None]) -> DataFrame:
    """Rows that match every given category, ignoring case; a None filter matches everything."""
    for column, wanted in filters.items():
        if wanted is not None:
            if not isinstance(wanted, str) or not wanted.strip():
                raise ValueError(f"the filter on {column} needs some text")
            df = df.filter(F.lower(F.col(column).cast("string")) == F.lower(F.lit(wanted)))
    return df


def ids_in_scope(selected: DataFrame, ids: DataFrame, identity: str) -> tuple[DataFrame, DataFrame]:
    """Selected rows named by an ID list, and the named IDs that are outside the selection."""
    return selected.join(ids, identity, "left_semi"), ids.join(selected, identity, "left_anti")


def billable_split(assignments: DataFrame, keys: Sequence[str], flag: str = "billable") -> DataFrame:
    return assignments.groupBy(*keys).agg(F.count_if(F.col(flag)).alias("billable"), F.count_if(~F.col(flag)).alias("shadow"), F.count("*").alias("total"))


def eligible_rows(selected: DataFrame, targets: Mapping[str, object]) -> Column:
    """For a shift, rows not already at every target."""
    off_target = F.lit(False)
    for column, target in targets.items():
        off_target = off_target | (F.col(column) != target)
    return off_target


def _holds(condition: Column, message: str) -> Column:
    """True, or an error when the query runs."""
    return F.when(condition, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean"))


def whatif(
    assignments: DataFrame, action: str, percent=0, filters: Mapping[str, str | None] | None = None, targets: Mapping[str, object] | None = None, identity: str = "assignment_id",
    ids: DataFrame | None = None,
) -> DataFrame:
    """The overlay of a workforce scenario: every baseline row with flags and resulting columns.

    Adds ``selected``, ``affected``, ``removed`` and ``new_<target>`` columns plus the cohort numbers.
    Reduce removes the first ``round_half_up(eligible * percent / 100)`` eligible rows by ascending
    identity; shift moves them to the targets; rows already at target are not eligible. ``ids`` names the
    rows to select within the filters, and every one of them must be there; a target must be a category of
    the population.
    """
    targets = dict(targets or {})
    if action not in ("baseline", "reduce", "shift"):
        raise ValueError("action is one of baseline, reduce, shift")
    if not 0 <= percent <= 100 or (action == "baseline" and percent != 0):
        raise ValueError("percentage must be between 0 and 100, and 0 for the baseline")
    if (action == "shift") != bool(targets):
        raise ValueError("a shift needs targets and nothing else takes them")
    marked = assignments.withColumn("selected", F.lit(True))
    for column, wanted in (filters or {}).items():
        if wanted is not None:
            marked = marked.withColumn("selected", F.col("selected") & (F.lower(F.col(column).cast("string")) == F.lower(F.lit(wanted))))
    marked = marked.withColumn("selected", F.coalesce("selected", F.lit(False)))
    for column, target in targets.items():
        known = assignments.agg(F.count_if(F.col(column) == target).alias("n")).scalar()
        marked = marked.filter(_holds(known > 0, f"no row of the population has the target {column}"))
    if ids is not None:
        named = ids.select(identity).distinct()
        outside = ids_in_scope(marked.filter("selected"), named, identity)[1].agg(F.count("*").alias("n")).scalar()
        listed = marked.join(named.withColumn("_named", F.lit(True)), identity, "left").filter(_holds(outside == 0, "an ID of the list is outside the selection"))
        marked = listed.withColumn("selected", F.col("selected") & F.coalesce("_named", F.lit(False))).drop("_named")
    eligible = F.col("selected") & (eligible_rows(marked, targets) if action == "shift" else F.lit(True))
    marked = marked.withColumn("eligible", F.coalesce(eligible, F.lit(False)))
    total = marked.agg(F.count_if("eligible").alias("eligible_count"))
    sized = cohort_columns(marked.withColumn("eligible_count", total.scalar()), percent)
    affected = F.lit(False)
    if action != "baseline":
        # Only identities of eligible rows are placed in order; the overlay itself is never ranked or moved.
        cut = kth(marked.filter("eligible"), identity, cohort_columns(total, percent).select(F.col("affected_count").alias("_k"))).scalar()
        affected = F.coalesce(F.col("eligible") & (F.col(identity) <= cut), F.lit(False))
    result = sized.withColumn("affected", affected).withColumn("removed", F.col("affected") & F.lit(action == "reduce"))
    for column, target in targets.items():
        result = result.withColumn(f"new_{column}", F.when(F.col("affected"), F.lit(target)).otherwise(F.col(column)))
    return result


def whatif_counts(overlay: DataFrame, dimensions: Mapping[str, str]) -> DataFrame:
    """Counts per category before and after, of all rows and of the selected ones; ``dimensions`` maps each column to
    its resulting column."""
    before, after = list(dimensions), list(dimensions.values())
    rows = F.array(
        F.struct(*[F.col(c).cast("string").alias(b) for b, c in zip(before, before)], F.lit(1).alias("_before"), F.lit(0).alias("_after")),
        F.struct(*[F.col(c).cast("string").alias(b) for b, c in zip(before, after)], F.lit(0).alias("_before"), F.when(F.col("removed"), 0).otherwise(1).alias("_after")),
    )
    of = lambda flag, count: F.sum(F.when(F.col(flag), F.col(count)).otherwise(0))
    return (
        overlay.select("affected", "selected", F.inline(rows))
        .groupBy(*before)
        .agg(
            F.sum("_before").alias("baseline_count"), F.sum("_after").alias("resulting_count"), of("affected", "_before").alias("affected_from"),
            of("selected", "_before").alias("selected_baseline"), of("selected", "_after").alias("selected_resulting"),
        )
    )
