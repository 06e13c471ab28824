"""Repair of amounts: currencies, units mistaken for principals, signs, filer quarters out of scale, subtotal rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.semantics import close, truthy

# Currencies told in unit texts, words, and limits.
CURRENCIES = "USD EUR GBP CAD AUD NZD CHF SEK NOK DKK JPY CNY HKD SGD KRW TWD INR MXN BRL ZAR PLN CZK HUF TRY ILS EGP ISK THB".split()
FIXED_MEMBERS = ("FixedMember", "FixedRateMember")
EQUITY_TEXT = r"(?i)\b(?:preferred|equity|units?|warrants?|common|shares|membership)\b"
AGREE, OUT_OF_LINE = (0.5, 2.0), 3.0
EQUITY_UNITS = 100.0
MISTAG_RATES, MISTAG_TOLERANCE, MISTAG_COST = (50.0, 500.0), 1.10, 1_000_000.0
OUTLIER_RATIO, OUTLIER_SHARE, OUTLIER_SCALE = 20.0, 0.25, 1000.0
AMOUNTS = ("PAR", "FV", "COST")


def agree(a: Column, b: Column) -> Column:
    """Whether two amounts are within a factor of two of each other."""
    return truthy(F.try_divide(a, b).between(*AGREE))


def currency_code(unit: Column) -> Column:
    """The first currency code that stands alone in a unit's text, else null."""
    found = F.regexp_extract(F.upper(unit), rf"(?<![A-Z])({'|'.join(CURRENCIES)})(?![A-Z])", 1)
    return F.when(found != "", found)


def rate_type(rows: DataFrame, enumeration: str = "rate_type_uri", identifier: str = "investment_identifier") -> DataFrame:
    """``RateType`` (after the last ``#``), ``is_fixed`` (null if untagged) and ``is_prime`` (by tag or by a text like ``Prime + 1 %``)."""
    member = F.element_at(F.split(enumeration, "#"), -1)
    prime = truthy(F.lower(member).contains("prime")) | truthy(F.col(identifier).rlike(r"(?i)\bprime\s*(?:rate\s*)?[+\-–]"))
    return rows.withColumns({"RateType": member, "is_fixed": member.isin(*FIXED_MEMBERS), "is_prime": prime})


def convert_currencies(rows: DataFrame, fx: DataFrame, tagged: list[str] | None = None) -> DataFrame:
    """Amounts in dollars by each one's own unit, with ``currency`` (of the principal, else value, else cost, else USD) and ``unit_mismatch_fixed``.

    ``fx``: ``(cal_q, currency, per_usd)``.  A principal is read in the value's
    currency where the two currencies lie far apart and only that reading is
    near the value; and in one of the ``tagged`` currencies of 50 to 500 per
    dollar where principal over cost matches that rate.
    """
    out = rows.withColumns({f"{c}_unit": currency_code(F.col(f"{c}_unit")) for c in AMOUNTS})
    for name in AMOUNTS:
        own = fx.select("cal_q", F.col("currency").alias(f"{name}_unit"), F.col("per_usd").alias(f"_{name}"))
        out = out.join(own, ["cal_q", f"{name}_unit"], "left")
    raw = F.col("PAR")

    def dollars(amount: Column, unit: str) -> Column:
        plain = F.col(f"{unit}_unit").isNull() | (F.col(f"{unit}_unit") == "USD")
        return F.when(plain, amount).otherwise(F.try_divide(amount, F.col(f"_{unit}")))

    out = out.withColumns({f"{c}_usd": dollars(F.col(c), c) for c in AMOUNTS} | {"_alt": dollars(raw, "FV")})
    near = lambda x: truthy(F.abs(F.try_divide(x, F.col("FV_usd"))).between(1 / 3, 3))
    far = ~truthy(F.abs(F.try_divide(F.col("PAR_usd"), F.col("_alt"))).between(0.5, 2))
    odd = truthy((F.col("FV_unit") == F.col("COST_unit")) & (F.col("PAR_unit") != F.col("FV_unit")) & (F.col("FV_usd") != 0))
    odd = odd & far & near(F.col("_alt")) & ~near(F.col("PAR_usd"))
    out = out.withColumn("_odd", odd).withColumns(
        {"PAR_usd": F.when(F.col("_odd"), F.col("_alt")).otherwise(F.col("PAR_usd")), "PAR_unit": F.when(F.col("_odd"), F.col("FV_unit")).otherwise(F.col("PAR_unit"))}
    )
    if tagged is None:
        tagged = [r[0] for r in out.select("PAR_unit").where(F.col("PAR_unit").isin(*CURRENCIES)).distinct().collect()]  # at most CURRENCIES
    rates = fx.where(F.col("per_usd").between(*MISTAG_RATES) & F.col("currency").isin(*tagged, "") & (F.col("currency") != "USD"))
    listed = rates.groupBy("cal_q").agg(F.array_sort(F.collect_list(F.struct("currency", "per_usd"))).alias("_rates"))
    cost = F.col("COST_usd")
    doubtful = (cost >= MISTAG_COST) & agree(F.col("FV_usd"), cost) & (F.col("PAR_usd") > OUT_OF_LINE * cost)
    fits = F.filter(
        "_rates",
        lambda r: (r["currency"] != F.coalesce("PAR_unit", F.lit(""))) & F.try_divide(raw, cost * r["per_usd"]).between(1 / MISTAG_TOLERANCE, MISTAG_TOLERANCE),
    )
    out = out.join(listed, "cal_q", "left").withColumn("_read", F.when(truthy(doubtful), F.get(fits, F.lit(0))))
    hit = F.col("_read").isNotNull()
    out = out.withColumns(
        {
            "PAR_usd": F.when(hit, raw / F.col("_read.per_usd")).otherwise(F.col("PAR_usd")),
            "PAR_unit": F.when(hit, F.col("_read.currency")).otherwise(F.col("PAR_unit")),
            "unit_mismatch_fixed": F.col("_odd") | hit,
        }
    )
    out = out.withColumn("currency", F.coalesce("PAR_unit", "FV_unit", "COST_unit", F.lit("USD")))
    return out.drop("_PAR", "_FV", "_COST", "_alt", "_odd", "_rates", "_read")


def fix_component_scale(rows: DataFrame) -> DataFrame:
    """Cash and in-kind parts of a split ``50 / 50`` become halves of the rate; a part far above the row's coupon that fits once divided by 100 is."""
    split = close(F.col("pic"), F.lit(0.5)) & close(F.col("pik"), F.lit(0.5)) & truthy(F.col("rate").between(0, 0.25))
    out = rows.withColumn("_split", split)
    half = {c: F.when(F.col("_split"), F.col("rate") / 2).otherwise(F.col(c)) for c in ("pic", "pik")}
    reference = F.coalesce(F.col("rate"), F.col("spread") + 0.06)
    out = out.withColumns(half).withColumn("_ref", reference)
    small = {c: F.when(truthy((F.col(c) > 0.2) & (F.col(c) > F.col("_ref") + 0.10) & (F.col(c) / 100 <= F.col("_ref"))), F.col(c) / 100).otherwise(F.col(c)) for c in ("pic", "pik")}
    return out.withColumns(small).drop("_split", "_ref")


def cap_unit_principals(rows: DataFrame, identifier: str = "investment_identifier") -> DataFrame:
    """Principals that count units are set to cost, with ``unit_flag``: over 100 times the cost of an equity, or under a third of a cost that value agrees with."""
    par, cost = F.col("PAR"), F.col("COST")
    many = truthy(F.col(identifier).rlike(EQUITY_TEXT)) & truthy((cost > 0) & (par > EQUITY_UNITS * cost))
    out = rows.withColumn("_many", many).withColumn("PAR", F.when(F.col("_many"), cost).otherwise(par))
    few = truthy((F.col("PAR") > 0) & (cost > OUT_OF_LINE * F.col("PAR"))) & agree(F.col("FV"), cost)
    out = out.withColumn("_few", few).withColumn("PAR", F.when(F.col("_few"), cost).otherwise(F.col("PAR")))
    return out.withColumn("unit_flag", F.when(F.col("_many"), "equity_units_capped").when(F.col("_few"), "units_as_principal")).drop("_many", "_few")


def fix_signs(rows: DataFrame) -> DataFrame:
    """A negative cost of a funded loan, or cost and value, turned positive where the sizes agree; ``sign_flag`` names what was turned."""
    par, cost, fv = F.col("PAR"), F.col("COST"), F.col("FV")
    funded = truthy((cost < 0) & (par > 0)) & agree(-cost, par)
    cost_only = funded & truthy(fv > 0) & agree(-cost, fv)
    both = funded & truthy(fv < 0) & agree(-fv, par)
    flag = F.when(cost_only, "cost").when(both, "cost and value")
    out = rows.withColumn("sign_flag", flag)
    return out.withColumns({"COST": F.when(F.col("sign_flag").isNotNull(), -cost).otherwise(cost), "FV": F.when(F.col("sign_flag") == "cost and value", -fv).otherwise(fv)})


def value_gap(par: Column, cost: Column, fv: Column) -> Column:
    """How principal, cost and value fit: na, consistent, principal_high|fv_..., cost_high or fv_high."""
    side = F.when(fv.isNull(), "fv_na").when(agree(fv, cost), "fv_cost").when(agree(fv, par), "fv_principal").otherwise("fv_neither")
    return (
        F.when(~truthy((par > 0) & (cost > 0)), "na")
        .when(par > OUT_OF_LINE * cost, F.concat(F.lit("principal_high|"), side))
        .when(cost > OUT_OF_LINE * par, "cost_high")
        .when(truthy((fv > OUT_OF_LINE * cost) & (fv > OUT_OF_LINE * par)), "fv_high")
        .otherwise("consistent")
    )


def others_median(totals: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """``totals`` (a row per group and period) with the median of the group's other periods, null without any, and ``_n`` periods.

    The list of a group is its periods, a few dozen.
    """
    whole = Window.partitionBy(group)
    listed = totals.withColumns({"_all": F.sort_array(F.collect_list(value).over(whole)), "_n": F.count(value).over(whole)})
    at = F.array_position("_all", F.col(value))
    rest = F.filter("_all", lambda x, i: i != F.col("_at") - 1)
    half = F.floor((F.col("_n") - 1) / 2).cast("int")
    odd = (F.col("_n") - 1) % 2 == 1
    middle = F.when(odd, F.get("_rest", half)).otherwise((F.get("_rest", half - 1) + F.get("_rest", half)) / 2)
    out = listed.withColumn("_at", at).withColumn("_rest", rest)
    return out.withColumn(name, F.when(F.col("_n") > 1, middle)).drop("_all", "_at", "_rest")


def filer_quarter_outliers(rows: DataFrame, filer: str = "cik", quarter: str = "cal_q", value: str = "FV") -> DataFrame:
    """``(filer, quarter, med_others, outlier)``: quarters whose total value is over 20 times the median of the filer's other quarters, of which there are two at least."""
    totals = rows.groupBy(filer, quarter).agg(F.coalesce(F.sum(F.abs(value)), F.lit(0.0)).alias("_total"))
    found = others_median(totals, filer, "_total", "med_others")
    return found.select(filer, quarter, "med_others", truthy((F.col("_n") > 2) & (F.col("med_others") > 0) & (F.col("_total") > OUTLIER_RATIO * F.col("med_others"))).alias("outlier"))


def rescale_filer_quarters(rows: DataFrame, filer: str = "cik", quarter: str = "cal_q", value: str = "FV") -> DataFrame:
    """In outlier quarters, positions over a quarter of the other quarters' median have all amounts divided by 1,000 (``rescaled``)."""
    found = filer_quarter_outliers(rows, filer, quarter, value)
    out = rows.join(found, [filer, quarter]).withColumn("rescaled", F.col("outlier") & truthy(F.abs(value) > OUTLIER_SHARE * F.col("med_others")))
    return out.withColumns({c: F.when(F.col("rescaled"), F.col(c) / OUTLIER_SCALE).otherwise(F.col(c)) for c in AMOUNTS}).drop("outlier", "med_others")


def drop_subtotals(rows: DataFrame, filing: tuple[str, ...] = ("cik", "accession"), identifier: str = "investment_identifier", value: str = "FV", tolerance: float = 0.05, least: int = 20) -> DataFrame:
    """``rows`` without those whose identifier ``least`` others of the filing extend by a separator and whose value is their sum.

    Every identifier lists its own prefixes that end before a separator, and is
    joined on them: no pair of identifiers is compared that is no extension.
    """
    key = [*filing, identifier]
    sums = rows.where(F.col(identifier).isNotNull()).groupBy(*key).agg(F.sum(value).alias("_sum"))
    text = F.col(identifier)
    ends = F.filter(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substring(text, i + 1, F.length(text)).rlike(r"^\s*[-–|,:;(]"))
    children = sums.where(F.length(text) > 1).select(*filing, F.explode(F.transform(ends, lambda i: F.substring(text, F.lit(1), i))).alias(identifier), F.col("_sum").alias("_part"))
    wholes = children.groupBy(*key).agg(F.count("*").alias("_n"), F.sum("_part").alias("_parts")).where((F.col("_n") >= least) & (F.col("_parts") != 0))
    gone = sums.join(wholes, key).where(F.abs(F.col("_sum") / F.col("_parts") - 1) <= tolerance).select(*key)
    return rows.join(gone, key, "left_anti")


def manual_overrides(rows: DataFrame, corrections: DataFrame, columns: tuple[str, ...] = AMOUNTS, key: tuple[str, ...] = ("accession", "context_id")) -> DataFrame:
    """``rows`` with the columns multiplied or replaced as ``corrections`` (``key``, column, factor, value) say."""
    by_row = corrections.groupBy(*key).agg(*[F.max(F.when(F.col("column") == c, F.struct("factor", "value"))).alias(f"_fix_{c}") for c in columns])
    out = rows.join(by_row, list(key), "left")
    fixed = {c: F.coalesce(F.col(f"_fix_{c}.value"), F.col(c) * F.coalesce(F.col(f"_fix_{c}.factor"), F.lit(1.0))) for c in columns}
    return out.withColumns(fixed).drop(*[f"_fix_{c}" for c in columns])


def classify_context(rows: DataFrame, terms: tuple[str, ...], amounts: tuple[str, ...]) -> Column:
    """Whether a row reports terms, amounts, both (mixed) or neither (empty)."""
    some = lambda names: reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in names])
    return F.when(some(terms) & some(amounts), "mixed").when(some(terms), "terms_only").when(some(amounts), "amounts_only").otherwise("empty")
