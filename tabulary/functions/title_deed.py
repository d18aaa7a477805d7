"""Title-deed fees as one Column expression over a struct of inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulary.functions.calculators import MINIMUM_WAGE

#: Fields of the input struct; all but transaction, buyer and amount may be null.
INPUT = (
    "transaction string, buyer string, amount double, market_value double, property_number int, one_off boolean, route string, gift_relation string, expropriator string, "
    "points_transfer string, given_value double, mortgage_amount double, first_home_gbp_rate double, fixed_fees boolean, stamp_duty boolean, vat_kind string, vat_area double, seller string, minimum_wage double"
)
#: Fixed values, percent: sales by buyer and how many properties the buyer then has.
SALE_CITIZEN, SALE_CITIZEN_ONCE = 6.0, 3.0
SALE = {
    "tc": {"direct": (6, 8, 9, 9, 9, 9), "contract": (3, 2, 3, 3, 3, 3), "transfer": (3, 6, 6, 6, 6, 6)},
    "foreign": {"direct": (9, 9, 9), "contract": (6, 3, 3), "transfer": (3, 6, 6)},
}
#: Fixed values, percent: other transactions.
GIFT = {"child": 0.2, "spouse": 0.4, "grandchild": 0.4, "other": 6.0}
POINTS = {"sale": 6.0, **GIFT}
EXPROPRIATION = {"public": 4.0, "private": 6.0}
EXCHANGE, EXCHANGE_DIFFERENCE, PRESCRIPTION, MORTGAGE = 3.0, 4.0, 5.0, 1.0
SHARE_CITIZEN, SHARE_FOREIGN = 0.05, 0.1
#: Amounts, thresholds and rates of the other lines.
PETITION, CERTIFICATE, FIRST_HOME_GBP = 71.0, 149.0, 100_000
STAMP_THRESHOLD, STAMP_LOWER, STAMP_UPPER = 89_000_000.0, 0.5, 0.1
VAT, VAT_LARGE, VAT_LARGE_FROM = 5.0, 10.0, 300
PROFIT, PROFIT_EXEMPT, WITHHOLDING = 20, 30, 20


def _cents(x: Column) -> Column:
    """Two decimals, halves away from zero; amounts are never negative."""
    return F.floor(x * 100 + 0.5) / 100


def _percent(base: Column, rate: Column) -> Column:
    return _cents(base * rate / 100)


def _pick(table: dict, key: Column, default: str) -> Column:
    found = F.create_map(*(F.lit(v) for pair in table.items() for v in pair))
    return F.coalesce(F.try_element_at(found, key), F.lit(table[default]))


def _step(buyer: Column, number: Column, how: str) -> Column:
    """A foreign buyer's rate for the given property, the last one for all beyond; null for citizens."""
    chain = F.lit(None).cast("double")
    for name, table in SALE.items():
        rates = table[how]
        at = F.least(F.greatest(F.coalesce(number, F.lit(1)), F.lit(1)), F.lit(len(rates)))
        chain = F.when(buyer == name, F.get(F.array(*(F.lit(float(r)) for r in rates)), at - 1)).otherwise(chain)
    return chain


def seller_tax_rate(seller: Column) -> Column:
    full = PROFIT * WITHHOLDING / 100
    return F.when(seller == "professional", full).when(seller == "individual", round(full * (100 - PROFIT_EXEMPT) / 100, 3)).otherwise(0.0)


def with_title_deed_fee(rows: DataFrame, column: str = "p", name: str = "fee") -> DataFrame:
    """``rows`` with ``name``: struct<base, rate, lines, land_office_total, total, seller_total, sale_saving, mortgage_saving>.

    A line is (key, base, rate, amount, payer); lines that do not apply are left out.
    """
    p = {f.split()[0]: F.col(f"{column}.{f.split()[0]}") for f in INPUT.split(", ")}
    yes = lambda c: F.coalesce(c, F.lit(False))
    or0 = lambda c: F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0))
    kind, buyer, amount = p["transaction"], p["buyer"], or0(p["amount"])
    sale, gift, citizen = kind == "sale", kind == "gift", buyer == "kktc"
    base = F.when(sale & yes(p["market_value"] > amount), p["market_value"]).otherwise(amount)
    home = citizen & kind.isin("sale", "mortgage") & yes(p["first_home_gbp_rate"] > 0)
    cap = _cents(FIRST_HOME_GBP * or0(p["first_home_gbp_rate"]))
    exempt = lambda b: F.when(home, F.least(b, cap)).otherwise(0.0)
    once = yes(p["one_off"])
    direct = F.when(citizen, F.when(once, SALE_CITIZEN_ONCE).otherwise(SALE_CITIZEN)).otherwise(_step(buyer, p["property_number"], "direct"))
    relation = F.coalesce(p["gift_relation"], F.lit("other"))
    flat = (
        F.when(gift, F.when((relation == "other") & citizen & once, SALE_CITIZEN_ONCE).otherwise(_pick(GIFT, relation, "other")))
        .when(kind == "exchange", EXCHANGE).when(kind == "prescription", PRESCRIPTION)
        .when(kind == "expropriation", _pick(EXPROPRIATION, p["expropriator"], "private")).when(kind == "points", _pick(POINTS, p["points_transfer"], "sale")).otherwise(0.0)
    )
    loan = F.when(kind == "mortgage", amount).when(sale, or0(p["mortgage_amount"])).otherwise(0.0)
    rate = F.when(sale, direct).when(kind == "mortgage", F.when(loan > 0, MORTGAGE).otherwise(0.0)).otherwise(flat)
    split = sale & ~citizen & yes(p["route"] == "contract")
    due = base - exempt(base)
    none = F.lit(None).cast("double")

    def line(test: Column, key: str, of: Column, at: Column, sum_: Column | None = None, payer: str = "buyer") -> Column:
        value = _percent(of, at) if sum_ is None else sum_
        return F.when(test, F.struct(F.lit(key).alias("key"), of.alias("base"), at.cast("double").alias("rate"), value.cast("double").alias("amount"), F.lit(payer).alias("payer")))

    difference = F.greatest(amount - or0(p["given_value"]), F.lit(0.0))
    stamp = _cents(F.least(amount, F.lit(STAMP_THRESHOLD)) * STAMP_LOWER / 100 + F.greatest(amount - STAMP_THRESHOLD, F.lit(0.0)) * STAMP_UPPER / 100)
    vat = F.when((p["vat_kind"] == "home") & yes(p["vat_area"] >= VAT_LARGE_FROM), VAT_LARGE).otherwise(VAT)
    wage = F.coalesce(p["minimum_wage"], F.lit(float(MINIMUM_WAGE)))
    kin = gift & relation.isin("child", "spouse")
    seller = F.coalesce(p["seller"], F.lit("none"))
    office = F.array_compact(F.array(
        line(split, "fee-contract", due, _step(buyer, p["property_number"], "contract")), line(split, "fee-transfer", due, _step(buyer, p["property_number"], "transfer")),
        line(sale & ~split, "fee", due, direct), line(~sale & (kind != "mortgage"), "fee", base, flat),
        line((kind == "exchange") & (difference > 0), "exchange-difference", difference, F.lit(EXCHANGE_DIFFERENCE)),
        line(loan > 0, "mortgage", loan - exempt(loan), F.lit(MORTGAGE)),
        line(sale & (amount > 0), "gkk", amount, F.when(citizen, SHARE_CITIZEN).otherwise(SHARE_FOREIGN)), line(yes(p["fixed_fees"]), "fixed", none, none, F.lit(PETITION + CERTIFICATE)),
    ))
    more = F.array_compact(F.array(
        line(sale & yes(p["stamp_duty"]) & (amount > 0), "stamp", amount, F.lit(STAMP_LOWER), stamp), line(sale & p["vat_kind"].isNotNull() & (amount > 0), "vat", amount, vat),
        line(sale & ~citizen, "permit", none, none, _cents(wage / 2)),
        line((sale | gift) & (seller != "none"), "seller-tax", base, F.when(kin, 0.0).otherwise(seller_tax_rate(seller)), payer="seller"),
    ))
    total = lambda lines, payer: _cents(F.aggregate(F.filter(lines, lambda x: x["payer"] == payer), F.lit(0.0), lambda a, x: a + x["amount"]))
    made = rows.withColumn("__office", office).withColumn("__lines", F.concat("__office", more))
    return made.withColumn(name, F.struct(
        base.alias("base"), rate.alias("rate"), F.col("__lines").alias("lines"), total(F.col("__office"), "buyer").alias("land_office_total"), total(F.col("__lines"), "buyer").alias("total"),
        total(F.col("__lines"), "seller").alias("seller_total"), F.when(home & sale, _percent(exempt(base), rate)).otherwise(0.0).alias("sale_saving"),
        F.when(home & (loan > 0), _percent(exempt(loan), F.lit(MORTGAGE))).otherwise(0.0).alias("mortgage_saving"),
    )).drop("__office", "__lines")
