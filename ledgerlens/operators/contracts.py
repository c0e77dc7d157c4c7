"""Contract listings, expiry windows, renewal terms and dimensions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.dates import as_of_literal, days_until, within_days

ATTENTION_DAYS = 90


def list_contracts(contracts: DataFrame, organization: str = "organization_id", organization_id=None, order: Sequence[str] = ("vendor_id",)) -> DataFrame:
    """Every contract, or those of one organization, in order."""
    scoped = contracts if organization_id is None else contracts.filter(F.col(organization) == organization_id)
    return scoped.orderBy(*order)


def expiring_contracts(contracts: DataFrame, as_of, days: int, end: str = "end_date", contract: str = "contract_id") -> DataFrame:
    """Contracts that end in ``[as_of, as_of + days]``, earliest first."""
    return contracts.filter(within_days(F.col(end), as_of, days)).withColumn("days_to_expiry", days_until(F.col(end), as_of)).orderBy(end, contract)


def dimension_values(df: DataFrame, entity: str, fields: Sequence[str]) -> DataFrame:
    """Distinct values of each named dimension per entity, as rows."""
    pairs = F.array(*[F.struct(F.lit(f).alias("dimension"), F.col(f).cast("string").alias("value")) for f in fields])
    return df.select(F.col(entity), F.inline(pairs)).filter("value IS NOT NULL").distinct()


def attention_state(end: Column, notice: Column, as_of) -> Column:
    """expired, past_notice, notice_due, expiring or on_track, in that order of precedence."""
    today = as_of_literal(as_of)
    return (
        F.when(end < today, "expired")
        .when(notice < today, "past_notice")
        .when(F.datediff(notice, today) <= ATTENTION_DAYS, "notice_due")
        .when(F.datediff(end, today) <= ATTENTION_DAYS, "expiring")
        .otherwise("on_track")
    )


def past_notice(contracts: DataFrame, terms: DataFrame, as_of, contract: str = "contract_id", end: str = "end_date") -> DataFrame:
    """Live contracts whose renewal notice deadline has passed."""
    joined = contracts.join(terms, contract, "inner")
    return joined.filter(attention_state(F.col(end), F.col("notice_deadline"), as_of) == "past_notice")


def renewal_priority(end: Column, critical_applications: Column, as_of, days: int = 120) -> Column:
    """High when expiry is near and critical applications depend on it, Review when near, else Monitor."""
    near = days_until(end, as_of).between(0, days)
    return F.when(near & (critical_applications > 0), "High").when(near, "Review").otherwise("Monitor")


def effective_join(facts: DataFrame, crosswalk: DataFrame, keys: Sequence[str], at: str, start: str = "effective_from", end: str = "effective_to") -> DataFrame:
    """Equi-join on the keys where the fact's date lies in the crosswalk's closed interval."""
    return facts.join(crosswalk, list(keys), "inner").filter(F.col(at).between(F.col(start), F.col(end)))
