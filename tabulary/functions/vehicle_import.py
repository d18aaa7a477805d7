"""Vehicle-import duties as one Column expression over a struct of inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulary.functions.calculators import MINIMUM_WAGE

#: Fields of the input struct; all but cif, fuel and origin may be null.
INPUT = (
    "vehicle_type string, cif double, fuel string, engine_cc int, origin string, commercial boolean, age_years int, classic boolean, built_by_1983 boolean, temporary boolean, "
    "not_own_name boolean, double_cab boolean, weight_kg double, road_tax boolean, motor_kw double, disability_group string, adapted boolean, cif_gbp double"
)
#: Fixed values, percent: customs.
CUSTOMS, CUSTOMS_PETROL_CC, CUSTOMS_DIESEL_CC = 10.0, 2000, 2500
PICKUP_DIESEL_CC, PICKUP_PETROL_CC, PICKUP_UP_TO, PICKUP_ABOVE, PICKUP_ELECTRIC = 2500, 2800, 10.0, 22.0, 10.0
TRUCK, TRUCK_ELECTRIC = 22.0, 10.0
MOTORCYCLE_CC, MOTORCYCLE_SMALL, MOTORCYCLE_LARGE, MOTORCYCLE_ELECTRIC = 250, 14.5, 6.0, 6.0
#: Fund, (cc up to, percent); factors for one origin; pickups by age; motorcycles (cc up to, amount, preferential, general).
FUND = ((1500, 3.0), (2000, 3.0), (3000, 8.0), (None, 12.0))
FUND_ELECTRIC, FUND_TC_FIRST, FUND_TC_OTHER = 5.0, 0.5, 0.7
PICKUP_FUND = {"new": (5.0, 2.0), "under_8": (16.0, 6.0), "from_8": (31.0, 21.0)}
PICKUP_TC_NEW, DOUBLE_CAB_KG, DOUBLE_CAB_AMOUNT = 7.0, 2032, 3000.0
CLASSIC_AGE, CLASSIC_AMOUNT, CLASSIC_RATE = 25, 750.0, 6.0
MOTORCYCLE_FUND = ((80, 0.0, 8.5, 6.0), (125, 375.0, 18.5, 14.5), (None, 750.0, 23.5, 35.0))
#: Fixed values, percent and amounts: the other lines.
WHARF, SHARE, WITHHOLDING = 4.4, 2.5, 4.0
VAT_CAR, VAT_OTHER, VAT_ELECTRIC, VAT_LARGE_MOTORCYCLE = 20.0, 16.0, 5.0, 20.0
REGISTRATION, REGISTRATION_CLEAN, TEMPORARY_REGISTRATION = 6.0, 4.0, 18_725.0
TEMPORARY_SHARE, NOT_OWN_NAME, CLASSIC_DISCOUNT = 0.5, 6.0, 65
#: Yearly road tax by kind; cars by weight (limits, amount per kg).
ROAD_CAR = {
    "petrol": ((1016, 2.09), (1270, 3.6), (1524, 8.75), (None, 12.5)), "diesel": ((1016, 3.02), (1270, 5.34), (1524, 13.42), (None, 18.69)),
    "hybrid": ((1016, 1.8), (1270, 2.92), (1524, 6.4), (None, 8.75)), "electric": ((1366, 1.12), (1670, 1.96), (1974, 4.18), (None, 6.15)),
}
ROAD_DOUBLE_CAB = {"petrol": 15_950.0, "diesel": 15_950.0, "hybrid": 6_540.0, "electric": 5_215.0}
ROAD_SINGLE_CAB = {"diesel": 12_655.0, "hybrid": 7_969.0, "electric": 5_195.0}
ROAD_MOTORCYCLE = ((100, 558.0), (300, 976.0), (500, 1_394.0), (None, 2_789.0))
ROAD_ELECTRIC_MOTORCYCLE = ((3, 418.0), (18, 697.0), (50, 1_115.0), (None, 2_091.0))
#: Limits for drivers with a disability, and ages that may be imported.
CUSTOMS_MOST_CC, CUSTOMS_MOST_GBP, SMALL_CC, ADAPTED_CC = 3000, 30_000, 1600, 2500
AGE_PASSENGER, AGE_WORK = 5, 12


def _cents(x: Column) -> Column:
    return F.floor(x * 100 + 0.5) / 100


def _percent(base: Column, rate: Column) -> Column:
    return _cents(base * rate / 100)


def _band(value: Column, bands, pick=lambda row: row[1]) -> Column:
    """The entry of the first band that reaches the value."""
    chain = None
    for row in bands:
        if row[0] is None:
            return chain.otherwise(pick(row))
        chain = F.when(value <= row[0], pick(row)) if chain is None else chain.when(value <= row[0], pick(row))
    return chain


def _by(key: Column, table: dict) -> Column:
    chain = F.lit(None).cast("double")
    for name, value in table.items():
        chain = F.when(key == name, value).otherwise(chain)
    return chain


def with_vehicle_import(rows: DataFrame, column: str = "p", name: str = "duty", minimum_wage: float = MINIMUM_WAGE) -> DataFrame:
    """``rows`` with ``name``: struct<lines, vat_base, customs_total, total, landed_cost, burden_percent, classic, new_work_vehicle>.

    A line is (key, rate, amount, exempt), in the order of the law: each tax's base
    may hold the lines before it.
    """
    p = {f.split()[0]: F.col(f"{column}.{f.split()[0]}") for f in INPUT.split(", ")}
    yes = lambda c: F.coalesce(c, F.lit(False))
    kind, fuel, cc = F.coalesce(p["vehicle_type"], F.lit("car")), p["fuel"], F.coalesce(p["engine_cc"], F.lit(0))
    car, pickup, truck, moto = kind == "car", kind == "pickup", kind == "truck", kind == "motorcycle"
    electric, general, tc = fuel == "electric", p["origin"] == "other", p["origin"] == "tc"
    cif, age = F.greatest(p["cif"], F.lit(0.0)), p["age_years"]
    temporary = yes(p["temporary"]) & car
    classic = yes(p["classic"]) & car & yes(age >= CLASSIC_AGE) & ~temporary
    new_work = age.isNull() & (truck | (pickup & fuel.isin("hybrid", "electric")))

    customs = (
        F.when(moto, F.when(~general, 0.0).when(electric, MOTORCYCLE_ELECTRIC).when(cc > MOTORCYCLE_CC, MOTORCYCLE_LARGE).otherwise(MOTORCYCLE_SMALL))
        .when(truck, F.when(~general, 0.0).when(electric, TRUCK_ELECTRIC).otherwise(TRUCK))
        .when(pickup, F.when(~general, 0.0).when(electric, PICKUP_ELECTRIC).when(cc > F.when(fuel == "diesel", PICKUP_DIESEL_CC).otherwise(PICKUP_PETROL_CC), PICKUP_ABOVE).otherwise(PICKUP_UP_TO))
        .when(general, CUSTOMS).when((fuel == "petrol") & (cc > CUSTOMS_PETROL_CC), CUSTOMS).when((fuel == "diesel") & (cc > CUSTOMS_DIESEL_CC), CUSTOMS).otherwise(0.0)
    )
    column_of = lambda pair: F.when(general, pair[1]).otherwise(pair[0])
    used = F.when(age < 8, column_of(PICKUP_FUND["under_8"])).otherwise(column_of(PICKUP_FUND["from_8"]))
    pickup_fund = F.when(age.isNull(), F.when(tc, PICKUP_TC_NEW).otherwise(column_of(PICKUP_FUND["new"]))).otherwise(used)
    moto_cc = F.when(electric, F.lit(1 << 30)).otherwise(cc)
    moto_fund = F.when(general, _band(moto_cc, MOTORCYCLE_FUND, lambda r: r[3])).otherwise(_band(moto_cc, MOTORCYCLE_FUND, lambda r: r[2]))
    plain = _band(cc, FUND)
    car_fund = F.when(electric, FUND_ELECTRIC).when(tc, F.round(plain * F.when(cc <= FUND[0][0], FUND_TC_FIRST).otherwise(FUND_TC_OTHER), 3)).otherwise(plain)
    fund = F.when(classic, CLASSIC_RATE).when(pickup, pickup_fund).when(truck, F.when(age.isNull(), 0.0).otherwise(used)).when(moto, moto_fund).otherwise(car_fund)
    fund = F.when(temporary, F.round(fund * TEMPORARY_SHARE, 3) + F.when(yes(p["not_own_name"]), NOT_OWN_NAME).otherwise(0.0)).otherwise(fund)
    specific = F.when(moto, _band(moto_cc, MOTORCYCLE_FUND, lambda r: r[1])).when(classic, CLASSIC_AMOUNT).otherwise(0.0)
    cab = pickup & yes(p["double_cab"]) & yes((p["weight_kg"] > 0) & (p["weight_kg"] <= DOUBLE_CAB_KG))

    group, adapted = p["disability_group"], yes(p["adapted"])
    able = group.isNotNull() & car & ~temporary
    small, middle = ~electric & (cc <= SMALL_CC), ~electric & (cc > SMALL_CC) & (cc < ADAPTED_CC)
    no_customs = able & (electric | (cc <= CUSTOMS_MOST_CC)) & ~yes(p["cif_gbp"] > CUSTOMS_MOST_GBP)
    no_fund = able & small & (group != "neurological")
    no_registration = able & F.when(group == "orthopaedic", adapted & (small | middle)).when(group == "visual-mental", small).otherwise(small | (middle & adapted))
    no_share = able & adapted & (group != "cerebral-palsy-down")

    def line(key: str, rate: Column | None, amount: Column, when: Column | None = None, waived: Column | None = None) -> Column:
        free = F.lit(False) if waived is None else yes(waived)
        made = F.struct(F.lit(key).alias("key"), (F.lit(None) if rate is None else rate).cast("double").alias("rate"), F.when(free, 0.0).otherwise(amount).cast("double").alias("amount"), free.alias("exempt"))
        return made if when is None else F.when(when, made)

    lit = lambda v: F.lit(v)
    first = F.array_compact(F.array(
        line("customs", customs, _percent(cif, customs), waived=no_customs | temporary), line("fif", fund, _percent(cif, fund), waived=no_fund | (truck & age.isNull())),
        line("fif-specific", None, specific, specific > 0), line("fif-specific", None, lit(DOUBLE_CAB_AMOUNT), cab),
        line("wharf", lit(WHARF), _percent(cif, lit(WHARF)), ~temporary, new_work), line("gkk", lit(SHARE), _percent(cif, lit(SHARE)), ~temporary, no_share),
    ))
    total = lambda lines: F.aggregate(lines, F.lit(0.0), lambda a, x: a + x["amount"])
    d = rows.withColumn("__a", first).withColumn("__base", _cents(cif + total(F.col("__a"))))
    vat = F.when(new_work | temporary, 0.0).when(electric, VAT_ELECTRIC).when(car, VAT_CAR).when(moto & (cc > 200), VAT_LARGE_MOTORCYCLE).otherwise(VAT_OTHER)
    second = F.array_compact(F.array(line("withholding", lit(WITHHOLDING), _percent(cif, lit(WITHHOLDING)), yes(p["commercial"])), line("vat", vat, _percent(F.col("__base"), vat), waived=temporary)))
    d = d.withColumn("__b", F.concat("__a", second))
    registration = F.when(electric | (fuel == "hybrid"), REGISTRATION_CLEAN).otherwise(REGISTRATION)
    weight = p["weight_kg"]
    car_tax = F.when(weight > 0, _cents(weight * _by(fuel, {f: _band(weight, b) for f, b in ROAD_CAR.items()})))
    road = (
        F.when(moto & electric, F.when(p["motor_kw"] > 0, _band(p["motor_kw"], ROAD_ELECTRIC_MOTORCYCLE))).when(moto, _band(cc, ROAD_MOTORCYCLE))
        .when(pickup & yes(p["double_cab"]), _by(fuel, ROAD_DOUBLE_CAB)).when(pickup | truck, _by(fuel, ROAD_SINGLE_CAB)).otherwise(car_tax)
    )
    fee = F.when(classic & yes(p["built_by_1983"]), _cents(road * (100 - CLASSIC_DISCOUNT) / 100)).otherwise(road)
    share = int(minimum_wage * 0.05 + 0.5) / 100
    third = F.array_compact(F.array(
        line("registration", None, lit(TEMPORARY_REGISTRATION), temporary), line("registration", registration, _percent(cif, registration), ~temporary, no_registration),
        line("road-tax", None, F.when(no_registration, share).otherwise(_cents(fee + share)), yes(p["road_tax"]) & road.isNotNull()),
    ))
    d = d.withColumn("__c", F.concat("__b", third)).withColumn("__total", _cents(total(F.col("__c"))))
    made = F.struct(
        F.col("__c").alias("lines"), F.col("__base").alias("vat_base"), _cents(total(F.col("__b"))).alias("customs_total"), F.col("__total").alias("total"), _cents(cif + F.col("__total")).alias("landed_cost"),
        F.when(cif > 0, F.floor(F.col("__total") / cif * 10_000 + 0.5) / 100).otherwise(0.0).alias("burden_percent"), classic.alias("classic"), new_work.alias("new_work_vehicle"),
    )
    return d.withColumn(name, made).drop("__a", "__b", "__c", "__base", "__total")


def age_check(first_registration: Column, arrival: Column, limit: int = AGE_PASSENGER) -> Column:
    """struct<allowed, limit_date, age_years>: allowed until the day before the limit."""
    edge = F.add_months(first_registration, 12 * limit)
    age = F.year(arrival) - F.year(first_registration) - F.when(F.date_format(arrival, "MMdd") < F.date_format(first_registration, "MMdd"), 1).otherwise(0)
    return F.struct((arrival < edge).alias("allowed"), edge.alias("limit_date"), F.greatest(age, F.lit(0)).alias("age_years"))
