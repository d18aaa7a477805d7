import datetime

from pyspark.sql import functions as F

from tabulary.functions import calculators as C
from tabulary.functions import title_deed as D


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def d(text):
    return F.lit(text).cast("date")


def test_duration(spark):
    assert tuple(one(spark, C.service_duration(d("2025-01-31"), d("2025-02-28")))) == (0, 0, 28, 0, 28)
    assert tuple(one(spark, C.service_duration(d("2020-01-10"), d("2023-05-22")))) == (3, 4, 12, 40, 1228)
    assert tuple(one(spark, C.service_duration(d("2025-02-01"), d("2025-01-01")))) == (0, 0, 0, 0, 0)


def test_leave_and_severance(spark):
    none, no = F.lit(None).cast("date"), F.lit(False)
    assert one(spark, C.annual_leave(d("2020-01-01"), d("2025-03-01"), none, no, F.lit(4)))["usable_days"] == 14
    assert one(spark, C.annual_leave(d("2024-09-01"), d("2025-05-01"), d("2007-01-01"), no, F.lit(0)))["full_year_days"] == 18
    assert one(spark, C.annual_leave(d("2025-01-01"), d("2025-03-01"), none, no, F.lit(0)))["reason"] == "under-six-months"
    s = one(spark, C.severance(d("2020-01-01"), d("2025-02-01"), F.lit(52_000.0), no, F.lit(20), F.lit(5)))
    assert (s.weekly_wage, s.severance_weeks, s.notice_weeks, s.total, s.threshold_met) == (12_000, 5, 6, 132_000, True)


def test_wages_and_taxes(spark):
    o = one(spark, C.overtime(F.lit(17_600.0), F.lit(176.0), F.lit(10), F.lit(4), F.lit(1), F.lit(5), F.lit(10)))
    assert abs(o.total - (1100 + 600 + 800)) < 1e-9 and o.warnings == ["daily-limit"]
    p = one(spark, C.payroll(F.lit(100_000.0), F.lit("sgk"), F.lit(False), F.lit(None).cast("double")))
    assert (p.base, round(p.net_before_tax, 6), round(p.employer_cost, 6)) == (100_000, 87_000, 115_000)
    assert one(spark, C.payroll(F.lit(50_000.0), F.lit("sgk"), F.lit(True), F.lit(0.5))).base == C.MINIMUM_WAGE
    t = one(spark, C.progressive_tax(F.lit(100_000.0), F.lit(1)))
    assert (t.tax, t.marginal_rate) == (4_500 + 9_000 + 2_500, 25)
    assert C.yearly_allowance("child_c") == 72_000


def test_provident_and_others(spark):
    p = one(spark, C.provident_fund(d("2010-01-01"), d("2025-01-01"), F.lit(1000.0), F.lit("legacy"), F.lit(None).cast("double"), F.lit(None).cast("double")))
    assert (round(p.balance, 6), round(p.max_advance, 6), round(p.quarter, 6)) == (18_000, 9_000, 4_500)
    assert one(spark, C.provident_fund(d("2025-01-01"), d("2025-01-20"), F.lit(1000.0), F.lit("current"), F.lit(0.0), F.lit(0.0))).balance == 0
    m = one(spark, C.maternity(d("2025-06-30")))
    assert (m.mandatory_end, m.nursing_end) == (datetime.date(2025, 8, 10), datetime.date(2026, 3, 29))
    w = one(spark, C.work_permit_penalty(F.lit("unlicensed-employment"), F.lit(2), F.lit(3), F.lit(True), 1000))
    assert (w.multiplier, w.fine, w.court_most, w.prison_years) == (8, 16_000, 24_000, 2)


def test_title_deed(spark):
    base = dict.fromkeys(f.split()[0] for f in D.INPUT.split(", "))
    cases = [
        base | {"transaction": "sale", "buyer": "kktc", "amount": 1_000_000.0, "fixed_fees": True, "stamp_duty": True, "vat_kind": "home", "vat_area": 120.0, "seller": "individual"},
        base | {"transaction": "sale", "buyer": "tc", "amount": 2_000_000.0, "property_number": 2, "route": "contract", "minimum_wage": 70_893.0},
        base | {"transaction": "sale", "buyer": "kktc", "amount": 8_000_000.0, "first_home_gbp_rate": 55.0, "mortgage_amount": 1_000_000.0},
        base | {"transaction": "gift", "buyer": "kktc", "amount": 500_000.0, "gift_relation": "child", "seller": "professional"},
        base | {"transaction": "exchange", "buyer": "kktc", "amount": 300_000.0, "given_value": 100_000.0},
        base | {"transaction": "mortgage", "buyer": "foreign", "amount": 100_000.0},
    ]
    rows = spark.createDataFrame([(i, tuple(c.values())) for i, c in enumerate(cases)], f"i int, p struct<{', '.join(f.replace(' ', ':') for f in D.INPUT.split(', '))}>")
    got = [r.fee for r in D.with_title_deed_fee(rows).orderBy("i").collect()]
    lines = [{x.key: x.amount for x in f.lines} for f in got]
    assert lines[0] == {"fee": 60_000, "gkk": 500, "fixed": 220, "stamp": 5_000, "vat": 50_000, "seller-tax": 28_000} and got[0].total == 115_720 and got[0].seller_total == 28_000
    assert lines[1] == {"fee-contract": 40_000, "fee-transfer": 120_000, "gkk": 2_000, "permit": 35_446.5} and got[1].rate == 8
    assert lines[2] == {"fee": 150_000, "mortgage": 0, "gkk": 4_000} and (got[2].sale_saving, got[2].mortgage_saving) == (330_000, 10_000)
    assert lines[3] == {"fee": 1_000, "seller-tax": 0} and lines[4] == {"fee": 9_000, "exchange-difference": 8_000} and lines[5] == {"mortgage": 1_000}


def test_vehicle_import(spark):
    from tabulary.functions import vehicle_import as V

    base = dict.fromkeys(f.split()[0] for f in V.INPUT.split(", "))
    cases = [
        base | {"cif": 100_000.0, "fuel": "petrol", "engine_cc": 1600, "origin": "other", "commercial": True, "weight_kg": 1200.0, "road_tax": True},
        base | {"cif": 100_000.0, "fuel": "diesel", "engine_cc": 1400, "origin": "tc", "disability_group": "orthopaedic", "adapted": True},
        base | {"vehicle_type": "truck", "cif": 100_000.0, "fuel": "diesel", "engine_cc": 6000, "origin": "other"},
        base | {"cif": 100_000.0, "fuel": "electric", "origin": "eu", "temporary": True, "not_own_name": True},
        base | {"vehicle_type": "motorcycle", "cif": 10_000.0, "fuel": "petrol", "engine_cc": 100, "origin": "other", "road_tax": True},
        base | {"cif": 100_000.0, "fuel": "petrol", "engine_cc": 3500, "origin": "other", "classic": True, "age_years": 30, "weight_kg": 1000.0, "road_tax": True, "built_by_1983": True},
    ]
    rows = spark.createDataFrame([(i, tuple(c.values())) for i, c in enumerate(cases)], f"i int, p struct<{', '.join(f.replace(' ', ':') for f in V.INPUT.split(', '))}>")
    got = [r.duty for r in V.with_vehicle_import(rows).orderBy("i").collect()]
    lines = [{x.key: round(x.amount, 2) for x in g.lines} for g in got]
    assert lines[0] == {"customs": 10_000, "fif": 3_000, "wharf": 4_400, "gkk": 2_500, "withholding": 4_000, "vat": 23_980, "registration": 6_000, "road-tax": 4_355.45}
    assert (got[0].vat_base, got[0].customs_total, got[0].burden_percent) == (119_900, 47_880, 58.24)
    assert lines[1] == {"customs": 0, "fif": 0, "wharf": 4_400, "gkk": 0, "vat": 20_880, "registration": 0}
    assert lines[2] == {"customs": 22_000, "fif": 0, "wharf": 0, "gkk": 2_500, "vat": 0, "registration": 6_000} and got[2].new_work_vehicle
    assert lines[3] == {"customs": 0, "fif": 8_500, "vat": 0, "registration": 18_725}
    assert lines[4] == {"customs": 1_450, "fif": 1_450, "fif-specific": 375, "wharf": 440, "gkk": 250, "vat": 2_234.4, "registration": 600, "road-tax": 593.45}
    assert got[5].classic and lines[5]["fif"] == 6_000 and lines[5]["fif-specific"] == 750 and lines[5]["road-tax"] == 766.95
    a = one(spark, V.age_check(d("2021-03-01"), d("2026-02-28")))
    assert (a.allowed, a.age_years) == (True, 4) and not one(spark, V.age_check(d("2021-03-01"), d("2026-03-01"))).allowed
