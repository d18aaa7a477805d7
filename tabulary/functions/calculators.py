"""Labour and tax calculators as Column expressions over one row of inputs.

Rates, tiers and amounts are fixed values from the law, stated in tables; each
calculator turns its table into conditions, so a parameter table of any length
is computed in one scan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulary.functions.text import let

#: Fixed values.
MINIMUM_WAGE = 70_893
WEEKS, MONTHS = 52, 12
#: Annual leave, (up to and including this many months, days); the last is open.
LEAVE_FROM, LEAVE_YOUNG, LEAVE = 6, 18, ((60, 14), (119, 18), (179, 22), (None, 25))
#: Severance and notice, (up to and including this many months, weeks).
SEVERANCE = ((2, 0), (5, 1), (11, 2), (23, 3), (60, 4), (None, 5))
NOTICE = ((6, 1), (11, 3), (23, 4), (60, 5), (None, 6))
COLLECTIVE_HEADS, COLLECTIVE_SHARE = 5, 0.2
#: Overtime uplifts, hours of a public holiday, limits of a day and a year.
WEEKDAY_UPLIFT, HOLIDAY_UPLIFT, HOLIDAY_HOURS, DAY_LIMIT, YEAR_LIMIT = 0.1, 0.5, 8, 4, 90
#: Percentages of employee and employer by scheme, without work accidents.
INSURANCE = {"sgk": (9.0, 10.5), "sgk_other": (13.0, 9.75), "legacy": (9.0, 10.5)}
PROVIDENT = {"sgk": (4, 4), "legacy": (5, 5)}
ACCIDENT_LEAST, ACCIDENT_MOST, CEILING = 0.5, 6.0, 7
#: Income tax, (width of bracket, percent), allowances and reductions.
BRACKETS = ((45_000, 10), (45_000, 20), (120_000, 25), (190_000, 30), (float("inf"), 37))
PERSONAL_ALLOWANCE, SPECIAL_RATE, SOCIAL_CAP = 655_000, 10, 13
ALLOWANCES = {"spouse": 8, "child_a": 6, "child_b": 8, "child_c": 11, "disability_50": 15, "disability_100": 30, "over_65": 5}
LARGE_FAMILY, LARGE_FAMILY_EACH = 15, 5
#: Provident fund.
PROVIDENT_RATES = {"legacy": (0.05, 0.05), "current": (0.04, 0.04)}
ADVANCE_SHARE, QUARTER_YEARS, QUARTER_SHARE = 0.5, 15, 0.25
#: Weeks before and after birth, unpaid weeks, months of nursing.
MATERNITY_WEEKS, UNPAID_WEEKS, NURSING_MONTHS = 6, 6, 9


def _tier(months: Column, table) -> Column:
    chain = None
    for most, value in table:
        if most is None:
            return chain.otherwise(F.lit(value))
        chain = F.when(months <= most, F.lit(value)) if chain is None else chain.when(months <= most, F.lit(value))
    return chain


def _floor0(x: Column) -> Column:
    return F.greatest(F.coalesce(x, F.lit(0)), F.lit(0))


def service_duration(start: Column, end: Column) -> Column:
    """struct<years, months, days, total_months, total_days>; zeros where the end is before the start.

    A month is full on the same day of the month; the anniversary is clamped to a month's last day.
    """
    whole = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start) - F.when(F.dayofmonth(end) < F.dayofmonth(start), 1).otherwise(0)
    total = F.when(end < start, 0).otherwise(F.greatest(whole, F.lit(0)))

    def made(m: Column) -> Column:
        past = end < start
        return F.struct(
            F.floor(m / 12).cast("int").alias("years"), (m % 12).cast("int").alias("months"),
            F.when(past, 0).otherwise(F.datediff(end, F.add_months(start, m))).cast("int").alias("days"),
            m.cast("int").alias("total_months"), F.when(past, 0).otherwise(F.datediff(end, start)).cast("int").alias("total_days"),
        )

    return let(total.cast("int"), made)


def annual_leave(start: Column, as_of: Column, birth: Column, seasonal: Column, used: Column) -> Column:
    """struct<reason, full_year_days, pro_rated_days, usable_days, remaining_days>; reason is null where leave is due."""

    def made(d: Column) -> Column:
        months, years = d["total_months"], d["years"]
        reason = F.when(F.coalesce(seasonal, F.lit(False)), "seasonal").when(months < LEAVE_FROM, "under-six-months")
        young = birth.isNotNull() & (service_duration(birth, as_of)["years"] <= 18)
        tier = _tier(months, LEAVE)
        floor = F.when(young & (tier < LEAVE_YOUNG), F.lit(LEAVE_YOUNG)).otherwise(F.lit(0))
        full = F.greatest(tier, floor)
        part = full * (months % 12) / 12
        usable = F.when(years >= 1, F.greatest(_tier(years * 12, LEAVE), floor).cast("double")).otherwise(part)
        due = lambda x: F.when(reason.isNull(), x).otherwise(F.lit(0.0))
        return F.struct(reason.alias("reason"), due(full.cast("double")).alias("full_year_days"), due(part).alias("pro_rated_days"),
                        due(usable).alias("usable_days"), due(F.greatest(usable - _floor0(used), F.lit(0.0))).alias("remaining_days"))

    return let(service_duration(start, as_of), made)


def severance(start: Column, end: Column, wage: Column, seasonal: Column, headcount: Column, dismissed: Column) -> Column:
    """struct<weekly_wage, severance_weeks, severance, notice_weeks, notice, total, threshold_met>."""

    def made(months: Column) -> Column:
        weekly = F.greatest(wage, F.lit(0.0)) * MONTHS / WEEKS
        weeks = F.when(F.coalesce(seasonal, F.lit(False)), F.lit(0)).otherwise(_tier(months, SEVERANCE))
        notice = _tier(months, NOTICE)
        known = (headcount > 0) & dismissed.isNotNull()
        met = F.when(known, (dismissed >= COLLECTIVE_HEADS) & (dismissed / headcount >= COLLECTIVE_SHARE))
        return F.struct(weekly.alias("weekly_wage"), weeks.alias("severance_weeks"), (weeks * weekly).alias("severance"), notice.alias("notice_weeks"),
                        (notice * weekly).alias("notice"), (weeks * weekly + notice * weekly).alias("total"), met.alias("threshold_met"))

    return let(service_duration(start, end)["total_months"], made)


def overtime(wage: Column, normal_hours: Column, weekday: Column, holiday: Column, public_days: Column, day_hours: Column, year_days: Column) -> Column:
    """struct<hourly, weekday, holiday, public_holiday, total, warnings>."""
    hourly = F.when(normal_hours > 0, F.greatest(wage, F.lit(0.0)) / normal_hours).otherwise(F.lit(0.0))

    def made(rate: Column) -> Column:
        a = _floor0(weekday) * rate * (1 + WEEKDAY_UPLIFT)
        b = _floor0(holiday) * rate * (1 + HOLIDAY_UPLIFT)
        c = _floor0(public_days) * rate * HOLIDAY_HOURS
        warnings = F.array_compact(F.array(F.when(_floor0(day_hours) > DAY_LIMIT, "daily-limit"), F.when(_floor0(year_days) > YEAR_LIMIT, "yearly-limit")))
        return F.struct(rate.alias("hourly"), a.alias("weekday"), b.alias("holiday"), c.alias("public_holiday"), (a + b + c).alias("total"), warnings.alias("warnings"))

    return let(hourly, made)


def payroll(wage: Column, scheme: Column, other_nationality: Column, accident_rate: Column, minimum_wage: Column | None = None) -> Column:
    """struct<base, employee_insurance, employer_insurance, employee_provident, employer_provident, net_before_tax, employer_cost>."""
    least = F.lit(float(MINIMUM_WAGE)) if minimum_wage is None else F.when(minimum_wage > 0, minimum_wage).otherwise(F.lit(float(MINIMUM_WAGE)))
    gross, sgk = F.greatest(F.coalesce(wage, F.lit(0.0)), F.lit(0.0)), scheme == "sgk"
    key = F.when(sgk & F.coalesce(other_nationality, F.lit(False)), "sgk_other").when(sgk, "sgk").otherwise("legacy")
    accident = F.least(F.lit(ACCIDENT_MOST), F.greatest(F.lit(0.0), F.coalesce(accident_rate, F.lit(ACCIDENT_LEAST))))
    pick = lambda table, k, i: F.create_map(*(F.lit(x) for n, v in table.items() for x in (n, float(v[i]))))[k]
    base = F.when(sgk & (gross > least * CEILING), least * CEILING).when(sgk & (gross > 0) & (gross < least), least).otherwise(gross)
    fund = F.when(sgk, "sgk").otherwise("legacy")
    employee, employer = base * pick(INSURANCE, key, 0) / 100, base * (pick(INSURANCE, key, 1) + accident) / 100
    employee_fund, employer_fund = gross * pick(PROVIDENT, fund, 0) / 100, gross * pick(PROVIDENT, fund, 1) / 100
    return F.struct(base.alias("base"), employee.alias("employee_insurance"), employer.alias("employer_insurance"), employee_fund.alias("employee_provident"),
                    employer_fund.alias("employer_provident"), (gross - employee - employee_fund).alias("net_before_tax"), (gross + employer + employer_fund).alias("employer_cost"))


def progressive_tax(base: Column, salaries: Column) -> Column:
    """struct<tax, marginal_rate> over the yearly brackets divided by the salaries of a year."""
    brackets = F.array(*(F.struct(F.lit(float(w)).alias("w"), F.lit(r).alias("r")) for w, r in BRACKETS))
    start = F.struct(F.greatest(base, F.lit(0.0)).alias("rest"), F.lit(0.0).alias("tax"), F.lit(0).alias("rate"))

    def step(a: Column, b: Column) -> Column:
        part = F.least(a["rest"], b["w"] / salaries)
        return F.struct((a["rest"] - part).alias("rest"), (a["tax"] + part * b["r"] / 100).alias("tax"), F.when(a["rest"] > 0, b["r"]).otherwise(a["rate"]).alias("rate"))

    return F.aggregate(brackets, start, step, lambda a: F.struct(a["tax"].alias("tax"), a["rate"].alias("marginal_rate")))


def yearly_allowance(kind: str) -> int:
    return PERSONAL_ALLOWANCE * ALLOWANCES[kind] // 100 // 100 * 100


def income_tax(wage: Column, contributions: Column, salaries: Column, spouse: Column, children: dict[str, Column], disability: Column, over_65: Column) -> Column:
    """struct<taxable_base, tax_before, reduction_rate, tax, marginal_rate>; children by child_a, child_b, child_c."""
    gross = F.greatest(F.coalesce(wage, F.lit(0.0)), F.lit(0.0))
    counts = {k: F.floor(_floor0(v)).cast("int") for k, v in children.items()}
    yearly = F.lit(PERSONAL_ALLOWANCE) + F.when(F.coalesce(spouse, F.lit(False)), yearly_allowance("spouse")).otherwise(0)
    for k, n in counts.items():
        yearly = yearly + n * yearly_allowance(k)
    age = F.when(F.coalesce(over_65, F.lit(False)), yearly_allowance("over_65")).otherwise(0)
    yearly = yearly + F.when(disability == "100", yearly_allowance("disability_100")).when(disability == "50", yearly_allowance("disability_50")).otherwise(age)
    social = F.least(F.greatest(F.coalesce(contributions, F.lit(0.0)), F.lit(0.0)), gross * SOCIAL_CAP / 100)
    base = F.greatest(gross - social - gross * SPECIAL_RATE / 100 - yearly / salaries, F.lit(0.0))
    heads = sum(counts.values(), F.lit(0))
    rate = F.when(heads >= 3, F.least(F.lit(100), LARGE_FAMILY + LARGE_FAMILY_EACH * (heads - 3))).otherwise(0)

    def made(b: Column) -> Column:
        return let(progressive_tax(b, salaries), lambda t: F.struct(b.alias("taxable_base"), t["tax"].alias("tax_before"), rate.alias("reduction_rate"), (t["tax"] - t["tax"] * rate / 100).alias("tax"), t["marginal_rate"].alias("marginal_rate")))

    return let(base, made)


def provident_fund(join: Column, as_of: Column, wage: Column, scheme: Column, growth: Column, interest: Column) -> Column:
    """struct<contributions, balance, max_advance, quarter>: month by month, with wage growth and interest."""
    rate = F.create_map(*(F.lit(x) for n, (a, b) in PROVIDENT_RATES.items() for x in (n, a + b)))[scheme]
    w, g, i = F.greatest(F.coalesce(wage, F.lit(0.0)), F.lit(0.0)), _floor0(growth).cast("double"), _floor0(interest).cast("double")

    def made(d: Column) -> Column:
        months = d["total_months"]
        monthly = F.when(i > 0, F.pow(1 + i, F.lit(1 / 12)) - 1).otherwise(F.lit(0.0))
        steps = F.when(months > 0, F.sequence(F.lit(0), months - 1)).otherwise(F.array().cast("array<int>"))
        paid = F.transform(steps, lambda m: F.when(g > 0, w / F.pow(1 + g, (months - m) / 12)).otherwise(w) * rate)
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("balance"))
        fold = F.aggregate(paid, start, lambda a, c: F.struct((a["sum"] + c).alias("sum"), (a["balance"] * (1 + monthly) + c).alias("balance")))
        return let(fold, lambda f: F.struct(f["sum"].alias("contributions"), f["balance"].alias("balance"), (f["balance"] * ADVANCE_SHARE).alias("max_advance"),
                                            F.when(d["years"] >= QUARTER_YEARS, f["balance"] * QUARTER_SHARE).otherwise(0.0).alias("quarter")))

    return let(service_duration(join, as_of), made)


def maternity(birth: Column) -> Column:
    """struct of the first and last days of mandatory and unpaid leave, and the last of nursing leave."""
    week = lambda n: F.date_add(birth, 7 * n)
    return F.struct(week(-MATERNITY_WEEKS).alias("mandatory_start"), F.date_sub(week(MATERNITY_WEEKS), 1).alias("mandatory_end"),
                    week(-MATERNITY_WEEKS - UNPAID_WEEKS).alias("unpaid_start"), F.date_sub(week(MATERNITY_WEEKS + UNPAID_WEEKS), 1).alias("unpaid_end"),
                    F.date_sub(F.add_months(birth, NURSING_MONTHS), 1).alias("nursing_end"))


def work_permit_penalty(kind: Column, count: Column, occurrence: Column, reported_stopped: Column, minimum_wage: float = MINIMUM_WAGE) -> Column:
    """struct<multiplier, fine, court_most, prison_years>."""
    unlicensed, n = kind == "unlicensed-employment", F.greatest(F.lit(1), F.floor(F.coalesce(count, F.lit(1))).cast("int"))
    repeat = F.when(occurrence == 2, 2.0).when(occurrence == 3, 4.0).otherwise(1.0) * F.when(F.coalesce(reported_stopped, F.lit(False)), 2).otherwise(1)
    multiplier = F.when(unlicensed, repeat).otherwise(0.5)
    court = F.when(unlicensed, 12 * minimum_wage * n).otherwise(F.lit(10 * minimum_wage))
    return F.struct(multiplier.alias("multiplier"), (multiplier * minimum_wage * n).alias("fine"), court.cast("double").alias("court_most"), F.when(unlicensed, 2).alias("prison_years"))
