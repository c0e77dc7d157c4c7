"""Known results on small in-code portfolios."""

from datetime import date
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import service
from ledgerlens.functions.dates import parse_iso_date
from ledgerlens.functions.money import parse_cents, parse_decimal, percent_of, variance
from ledgerlens.operators import contracts, dashboard, overlap, risk, spend, vendor360, workforce
from ledgerlens.operators.spend import MONTHS

AS_OF = "2026-09-28"


def test_variances_are_exact(spark):
    df = spark.createDataFrame([(D("2880673.98"), D("2585753.42")), (D("3728219.13"), D("3328767.09")), (D("5.00"), D("0.00")), (D("-1.00"), D("-3.00"))], "v decimal(18,2), b decimal(18,2)")
    amount, percent = variance(F.col("v"), F.col("b"))
    rows = df.select(amount.alias("a"), percent.alias("p")).collect()
    assert [(r.a, r.p) for r in rows] == [(D("294920.56"), D("11.41")), (D("399452.04"), D("12.00")), (D("5.00"), None), (D("2.00"), D("-66.67"))]


def test_percentage_ties_round_away_from_zero(spark):
    df = spark.createDataFrame([(D("0.01"), D("80.00")), (D("-0.01"), D("80.00")), (D("0.01"), D("200.00"))], "d decimal(18,2), b decimal(18,2)")
    assert [r[0] for r in df.select(percent_of(F.col("d"), F.col("b"))).collect()] == [D("0.01"), D("-0.01"), D("0.01")]


def test_strict_parsers(spark):
    df = spark.createDataFrame([("1.005", "2024-02-29"), ("NaN", "2023-02-29"), ("", "2024-2-9"), ("Infinity", "20240209"), ("-7", None)], "m string, d string")
    rows = df.select(parse_decimal(F.col("m")).alias("m"), parse_iso_date(F.col("d")).alias("d")).collect()
    assert [r.m for r in rows] == [D("1.005000"), None, None, None, D("-7.000000")]
    assert [r.d for r in rows] == [date(2024, 2, 29), None, None, None, None]


def test_expiry_window_is_inclusive(spark):
    ends = [("V-005", "2026-10-13"), ("V-001", "2026-12-27"), ("V-003", "2026-12-28"), ("V-018", "2026-10-28"), ("V-000", "2026-09-27"), ("V-009", "2026-09-28")]
    df = spark.createDataFrame(ends, "contract_id string, end string").select("contract_id", F.to_date("end").alias("end_date"))
    found = [(r.contract_id, r.days_to_expiry) for r in contracts.expiring_contracts(df, AS_OF, 90).collect()]
    assert found == [("V-009", 0), ("V-005", 15), ("V-018", 30), ("V-001", 90)]
    with pytest.raises(ValueError):
        contracts.expiring_contracts(df, AS_OF, 3651)


def test_attention_precedence(spark):
    rows = [("2026-09-27", "2026-09-01"), ("2027-01-01", "2026-09-27"), ("2027-01-01", "2026-12-27"), ("2026-12-01", None), ("2027-06-01", "2027-01-01"), (None, None)]
    df = spark.createDataFrame(rows, "e string, n string").select(F.to_date("e").alias("e"), F.to_date("n").alias("n"))
    states = [r[0] for r in df.select(contracts.attention_state(F.col("e"), F.col("n"), AS_OF)).collect()]
    assert states == ["expired", "past_notice", "notice_due", "expiring", "on_track", "on_track"]


def scenario(spark, rows):
    schema = "vendor_id string, year int, scenario string, " + ", ".join(f"{m} decimal(18,2)" for m in MONTHS) + ", amount decimal(18,2), ytd_amount decimal(18,2), budget_ytd_amount decimal(18,2), fy_amount decimal(18,2)"
    return spark.createDataFrame(rows, schema)


def test_missing_scenario_stays_unknown(spark):
    ten = [D("10.00")] * 12
    df = scenario(spark, [("V-1", 2026, "Budget", *ten, D("120.00"), D("80.00"), D("80.00"), D("120.00"))])
    row = spend.budget_forecast_actual(df).first()
    assert (row.budget, row.forecast, row.actual_ytd, row.missing_scenarios) == (D("120.00"), None, None, "Forecast,Actual")
    assert row.forecast_variance_amount is None and row.forecast_variance_pct is None


def test_month_reconciliation_reports_each_breach_once(spark):
    ten, eight = [D("10.00")] * 12, [D("10.00")] * 8 + [None] * 4
    good = [("V-1", 2026, "Budget", *ten, D("120.00"), D("80.00"), D("80.00"), D("120.00")), ("V-1", 2026, "Actual", *eight, D("80.00"), D("80.00"), D("80.00"), None)]
    assert spend.reconcile_months(scenario(spark, good), 8).count() == 0
    for change, rule in (
        (("V-2", 2026, "Budget", *ten, D("121.00"), D("80.00"), D("80.00"), D("121.00")), "months_vs_amount"), (("V-2", 2026, "Budget", *ten, D("120.00"), D("81.00"), D("80.00"), D("120.00")), "months_vs_ytd"),
        (("V-2", 2026, "Actual", *eight, D("80.00"), D("80.00"), D("80.00"), D("80.00")), "future_actual"), (("V-2", 2026, "Forecast", *ten, D("120.00"), D("80.00"), D("80.00"), D("119.00")), "annual_alias"),
        (("V-2", 2026, "Budget", D("-10.00"), D("30.00"), *ten[2:], D("120.00"), D("80.00"), D("80.00"), D("120.00")), "negative_month"),
    ):
        assert [r.rule for r in spend.reconcile_months(scenario(spark, [*good, change]), 8).collect()] == [rule]


def test_saving_scenario(spark):
    base = spark.createDataFrame([("V-001", D("12000000.00"))], "vendor_id string, baseline decimal(18,2)")
    row = spend.saving_scenario(base, "baseline", 25, D(50) * 100 / D(300), D(25) * 100 / D(300)).first()
    assert (row.gross_saving, row.net_saving.quantize(D("1")), row.modelled_cost.quantize(D("1"))) == (D("3000000.00"), D("2250000"), D("9750000"))


def people(spark, n=4, kind="Contractor"):
    return spark.createDataFrame([(f"ASN-{i:03d}", "US" if i % 2 else "IN", kind) for i in range(n)], "assignment_id string, country string, worker_type string")


def test_reduce_twenty_percent_of_four(spark):
    overlay = workforce.whatif(people(spark), "reduce", 20)
    hit = overlay.filter("affected").collect()
    assert [(r.assignment_id, r.eligible_count, r.affected_count, r.unrounded_equivalent, r.effective_percent) for r in hit] == [("ASN-000", 4, 1, D("0.80"), D("25.00"))]
    assert overlay.filter("NOT removed").count() == 3 and people(spark).count() == 4


def test_shift_excludes_rows_at_target_and_conserves_the_total(spark):
    both = people(spark).unionByName(people(spark, 2, "Consultant").withColumn("assignment_id", F.concat("assignment_id", F.lit("C"))))
    overlay = workforce.whatif(both, "shift", 50, targets={"worker_type": "Consultant"})
    counts = {r.worker_type: (r.baseline_count, r.resulting_count) for r in workforce.whatif_counts(overlay.drop("country"), {"worker_type": "new_worker_type"}).collect()}
    assert counts == {"Contractor": (4, 2), "Consultant": (2, 4)}
    with pytest.raises(ValueError):
        workforce.whatif(both, "reduce", 10, targets={"worker_type": "Consultant"})
    with pytest.raises(ValueError):
        workforce.whatif(both, "reduce", 101)


def test_breach_is_three_valued(spark):
    rows = [("a", True), ("a", None), ("b", False), ("b", None), ("c", False), ("c", False), ("d", None)]
    df = spark.createDataFrame(rows, "vendor_id string, breach boolean")
    assert {r.vendor_id: r.has_breach for r in risk.breach_rollup(df).collect()} == {"a": True, "b": None, "c": False, "d": None}


def test_service_credit_bands(spark):
    df = spark.createDataFrame([(44640, 90, D("833333.33"), D("99.9")), (1000, 20, D("100.00"), D("99.9")), (1000, 1, D("100.00"), D("99.9")), (0, 0, D("1.00"), D("99.9"))], "eligible_units bigint, failed_units bigint, fee_basis decimal(18,2), target decimal(9,4)")
    rows = risk.measured(df, "target").collect()
    assert [(r.actual, r.breach, r.credit_percent, r.credit) for r in rows] == [
        (D("99.7984"), True, 3, D("25000.00")), (D("98.0000"), True, 7, D("7.00")), (D("99.9000"), False, 0, D("0.00")), (None, None, None, None),
    ]


def test_breach_direction_and_target_agreement(spark):
    rows = [(5, 3, "lower_is_better", 3), (5, 3, "higher_is_better", 3), (5, 3, None, 3), (5, 3, "lower_is_better", 4), (None, 3, "lower_is_better", 3)]
    df = spark.createDataFrame(rows, "a int, t int, d string, o int")
    assert [r[0] for r in df.select(service.sla_breach(F.col("a"), F.col("t"), F.col("d"), F.col("o"))).collect()] == [True, False, None, None, None]


def test_concentration_ignores_portal_use(spark):
    bridge = spark.createDataFrame([("V-001", f"APP-{i}", "SUPPORTS") for i in range(4)] + [("V-001", "APP-4", "USES_PORTAL"), ("V-001", "APP-9", "SUPPORTS")], "vendor_id string, application_id string, relation string")
    critical = spark.createDataFrame([(f"APP-{i}",) for i in range(6)], "application_id string")
    row = risk.concentration(bridge, critical).first()
    assert (row.critical_supported, row.critical_total, row.percentage) == (4, 6, D("66.6667"))


def test_review_queue_reasons_and_priority(spark):
    columns = "contract_id string, vendor_id string, end string, budget decimal(18,2), forecast decimal(18,2), actual_ytd decimal(18,2), risk_status string, risk_tier string, sla_period string, sla_actual decimal(9,4), sla_target decimal(9,4), sla_breach boolean"
    rows = [
        ("C1", "V1", "2026-10-10", D("100.00"), D("105.01"), None, "Missing", "High", None, None, None, None), ("C2", "V2", "2028-01-01", D("100.00"), D("105.00"), None, "Current", "Low", None, None, None, False),
        ("C3", "V3", "2028-01-01", D("0.00"), D("5.00"), None, "Current", "High", "2026-08", D("99.0"), D("99.9"), True),
    ]
    records = spark.createDataFrame(rows, columns).withColumn("end_date", F.to_date("end")).drop("end")
    terms = spark.createDataFrame([("C2", 30, True, "2027-12-01")], "contract_id string, notice_days int, automatic_renewal boolean, d string").withColumn("notice_deadline", F.to_date("d"))
    lines = dashboard.dashboard_contracts(records, terms, AS_OF)
    queue = {r.contract_id: r for r in dashboard.review_queue(lines).collect()}
    assert set(queue) == {"C1", "C3"}
    assert queue["C1"].priority == "high" and queue["C1"].reasons == ["Contract expires 2026-10-10 (12 days)", "Risk assessment is missing", "forecast is 5.01% over budget"]
    assert queue["C3"].reasons == ["SLA breach in 2026-08: 99.0000% against a 99.9000% target", "Contract risk tier: High"]
    totals = dashboard.dashboard_totals(lines).first()
    assert (totals.contracts, totals.over_budget, totals.high_risk, totals.missing_assessment, totals.expiring) == (3, 2, 1, 1, 1)


def test_evidence_status_words(spark):
    df = spark.createDataFrame([("a", "synthetic_data"), ("a", "truncated_graph"), ("a", "sla_unknown"), ("b", "financial_periods")], "vendor_id string, code string")
    got = {r.vendor_id: (r.retrieval_status, r.gap_codes) for r in vendor360.evidence_status(df).collect()}
    assert got == {"a": ("incomplete", ["sla_unknown", "truncated_graph"]), "b": ("no_reported_gaps", [])}


def brute_pairs(index):
    pairs = {}
    for kind, key in {(k, x) for _, k, x in index}:
        members = sorted(v for v, k, x in index if (k, x) == (kind, key))
        for i, a in enumerate(members):
            for b in members[i + 1:]:
                pairs.setdefault((a, b), {}).setdefault(kind, set()).add(key)
    return pairs


def test_overlap_is_whole(spark):
    """Pairs, and groups with their members, give exactly the brute-force pairs."""
    index = [(v, "product", f"P{v % 2}") for v in range(7)] + [(v, "application", f"A{v // 2}") for v in range(7)] + [(1, "service", "S"), (6, "service", "S"), (3, "service", "S")]
    df = spark.createDataFrame(index, "vendor_id int, kind string, key string")
    wanted = brute_pairs(index)
    listed = {(r.vendor_a, r.vendor_b): r for r in overlap.overlap_pairs(df).collect()}
    assert set(listed) == set(wanted)
    for pair, row in listed.items():
        assert [row.shared_products, row.shared_applications, row.shared_services] == [sorted(wanted[pair].get(k, ())) for k in overlap.KINDS]
    kept = {}
    for r in overlap.overlap_members(df, overlap.overlap_groups(df)).collect():
        kept.setdefault((r.kind, r.key), set()).add(r.vendor_id)
    assert {(a, b) for members in kept.values() for a in members for b in members if a < b} == set(wanted)
    one = {r.vendor_id for r in overlap.overlap_for_vendor(df, 3).collect()}
    assert one == {b if a == 3 else a for a, b in wanted if 3 in (a, b)}


def test_overlap_of_many_vendors_on_one_key(spark):
    df = spark.range(300).selectExpr("id AS vendor_id", "'product' AS kind", "'P' AS key")
    group = overlap.overlap_groups(df).first()
    assert (group.vendor_count, group.pair_count) == (300, 44_850)
    assert overlap.overlap_pairs(df).count() == 44_850 and overlap.overlap_for_vendor(df, 7).count() == 299


def test_overlap_pairs_by_blocks(spark):
    """Blocks of two vendors give the pairs of every organization, each once, with the context of both sides."""
    index = [(v, v % 2, "product", "P") for v in range(12)] + [(v, v % 2, "application", f"A{v // 4}") for v in range(12)] + [(3, 1, "product", "P")]
    index += [(12, 0, "service", "S"), (13, 1, "service", "S"), (14, None, "product", "P"), (None, 0, "product", "P")]
    df = spark.createDataFrame(index, "vendor_id int, organization_id int, kind string, key string")
    context = spark.createDataFrame([(v, v * 10) for v in range(5)], "vendor_id int, amount int")
    found = overlap.overlap_pairs(df, ["organization_id"], context, block=2)
    assert found.columns == ["organization_id", "vendor_a", "vendor_b", "shared_products", "shared_applications", "shared_services", "amount_a", "amount_b"]
    own = lambda v: v * 10 if v < 5 else None
    wanted = [(a % 2, a, b, ["P"], [f"A{a // 4}"] if a // 4 == b // 4 else [], [], own(a), own(b)) for a in range(12) for b in range(a + 1, 12) if a % 2 == b % 2]
    assert sorted(map(tuple, found.collect())) == sorted(wanted)


def test_cents_are_rounded_once_from_the_digits(spark):
    from decimal import ROUND_HALF_UP, Decimal, localcontext

    good = ["0.0049999999", "0.005", "-0.005", "1.005", "-.5", "5.", "+7", "00012.3449999999999999999999999999999999", "1e2", "12.3456e-1", "5e-3", "4.9e-3", "5e-4", "123456789e-11", "-0", "0e999999999999999999999", "0.000", "9.995", "999999999999999999999999999999999999.994", "1e-99999999999999999999", "1.5E+30", " 2.345 ", "0.0149999999999999999999999999999999999999999999"]
    bad = ["", " ", ".", "e5", "1e", "1,0", "NaN", "Infinity", "1_0", "0x10", "1e36", "1e99999999999999999999", "--1", "1.2.3", None]
    df = spark.createDataFrame([(t,) for t in good + bad], "t string")
    got = [r.m for r in df.select(parse_cents(F.col("t")).alias("m")).collect()]
    with localcontext() as context:
        context.prec = 80
        want = [Decimal("0.00") if "9999999999999999999" in t and "e" in t else Decimal(t.strip()).quantize(Decimal("0.01"), rounding=ROUND_HALF_UP) for t in good]
    assert got == want + [None] * len(bad)
