"""Amounts tagged in the wrong unit by 1,000 or 1,000,000: a vote of each filing's rows, then rows against their own principal and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.semantics import truthy

# The units in question, how far amounts that agree lie apart, and what makes a position large.
SCALES = (1_000, 1_000_000)
IN_LINE, CLOSE, EXACT = (1 / 3, 3.0), (0.5, 2.0), (0.95, 1.05)
FILING_SHARE, LARGE_COST, TYPICAL_SIZES = 0.5, 1_000_000, 5.0


def _within(x: Column, band: tuple[float, float]) -> Column:
    return truthy(x.between(*band))


def others_median(totals: DataFrame, group: list[str], value: str, name: str) -> DataFrame:
    """``totals`` (a row per group and period) with the median of the group's other periods' known values; null without any.

    A group's list is its periods, a few dozen.
    """
    whole = F.sort_array(F.collect_list(value).over(Window.partitionBy(*group)))
    listed = totals.withColumn("_all", whole).withColumn("_at", F.coalesce(F.array_position("_all", F.col(value)), F.lit(0)))
    listed = listed.withColumn("_rest", F.filter("_all", lambda x, i: i != F.col("_at") - 1))
    n = F.size("_rest")
    half = F.floor(n / 2).cast("int")
    middle = F.when(n % 2 == 1, F.get("_rest", half)).otherwise((F.get("_rest", half - 1) + F.get("_rest", half)) / 2)
    return listed.withColumn(name, F.when(n > 0, middle)).drop("_all", "_at", "_rest")


def filing_principal_scale(rows: DataFrame, filing: tuple[str, ...] = ("cik", "accession"), filer: str = "cik", quarter: str = "cal_q") -> DataFrame:
    """Principals of filings that tag them all in another unit than their values, repaired, with ``filing_flag`` (null where nothing was done).

    A filing votes: half of its rows with a usable ratio of cost (else value) to
    principal lie about one scale.  Its total value has to be in line with the
    median of the filer's other quarters, so that it is the principal that is
    wrong.  Then rows that are out of line the same way are rescaled, and, of
    those without a ratio, the ones that come closer to the filer's usual principal.
    """
    par = F.col("PAR")
    value = F.when(F.col("COST") > 0, F.col("COST")).otherwise(F.col("FV"))
    out = rows.withColumn("_r", F.when((par > 0) & (value > 0), F.try_divide(value, par)))
    periods = [filer, quarter]
    history = out.groupBy(*periods).agg(
        F.coalesce(F.sum(F.abs("FV")), F.lit(0.0)).alias("_total"), F.median(F.when(par > 0, F.abs(par))).alias("_size")
    )
    history = others_median(others_median(history, [filer], "_total", "_others"), [filer], "_size", "_usual")
    history = history.withColumn("_in_line", _within(F.try_divide("_total", "_others"), IN_LINE)).select(*periods, "_in_line", "_usual")
    bands = {}
    for s in SCALES:
        bands[f"filing_mul{s}"] = (float(s), (0.3 * s, 3.0 * s))
        bands[f"filing_div{s}"] = (1 / s, (1 / (3 * s), 1 / (0.3 * s)))
    shares = {tag: F.try_divide(F.count_if(_within(F.col("_r"), band)), F.count("_r")) for tag, (_, band) in bands.items()}
    votes = out.groupBy(*filing).agg(*[shares[tag].alias(tag) for tag in bands])
    same = [F.col(f"v.{c}").eqNullSafe(F.col(f"o.{c}")) for c in filing]
    out = out.alias("o").join(votes.alias("v"), on=_all(same)).select("o.*", *[F.col(f"v.{t}") for t in bands]).join(history, periods, "left")
    flag, factor = None, None
    for tag, (times, _) in bands.items():
        off = truthy(F.col("_r") > IN_LINE[1]) if times > 1 else truthy(F.col("_r") < IN_LINE[0])
        closer = truthy(F.abs(F.log10(F.try_divide(par * times, F.col("_usual")))) < F.abs(F.log10(F.try_divide(par, F.col("_usual")))))
        hit = truthy(F.col(tag) >= FILING_SHARE) & truthy(F.col("_in_line")) & truthy(par > 0) & (off | (F.col("_r").isNull() & closer))
        flag = F.when(hit, tag) if flag is None else flag.when(hit, tag)
        factor = F.when(hit, times) if factor is None else factor.when(hit, times)
    out = out.withColumns({"filing_flag": flag, "PAR": par * F.coalesce(factor, F.lit(1.0))})
    return out.drop("_r", "_in_line", "_usual", *bands)


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def _landing(x: Column, band: tuple[float, float]) -> Column:
    """The scale that brings ``x`` into the band, null if it lies there or none does."""
    size = F.abs(x)
    out = F.when(_within(size, band) | x.isNull(), F.lit(None).cast("int"))
    for s in SCALES:
        out = out.when(_within(size / s, band), s)
    return out


def value_scales(rows: DataFrame, position: tuple[str, ...] = ("cik", "investment_identifier"), filing: tuple[str, ...] = ("cik", "accession")) -> DataFrame:
    """``rows`` (``FV, COST, PAR``) with units repaired, and ``FV_scale_flag, COST_scale_flag, PAR_scale_flag`` (unchanged, na, divN, mulN, unresolved, filing_...).

    In order: the filing's vote on its principals; value and cost over three
    times the principal that a scale brings in line are divided, but where both
    need the same one and the position's other rows have such a value, it is the
    principal that is multiplied; a principal far above a cost of LARGE_COST or
    more is divided; below that only if the ratio is exact, value and cost agree
    and the principal is far above the filer's usual one of the quarter; last,
    a value (or cost) exactly 1,000 times below a cost (or value) that the principal agrees with is multiplied.
    """
    out = filing_principal_scale(rows, filing)
    par = F.col("PAR")
    anchored = truthy(par != 0)
    for c in ("FV", "COST"):
        ratio = F.when(anchored, F.abs(F.try_divide(F.col(c), par)))
        fine = truthy(ratio <= IN_LINE[1])
        scale = F.when(anchored & ~fine, _landing(ratio, IN_LINE))
        done = F.when(ratio.isNull(), "na").when(fine, "unchanged").when(scale.isNotNull(), F.concat(F.lit("div"), scale.cast("string"))).otherwise("unresolved")
        out = out.withColumns({f"_s_{c}": scale, f"{c}_scale_flag": done})
    out = out.withColumn("PAR_scale_flag", F.when(par.isNull(), "na").otherwise("unchanged"))

    whole = _all([F.col(c).isNotNull() for c in position])
    usual = F.median(F.when(F.col("_s_FV").isNull() & (F.col("FV") != 0), F.abs("FV"))).over(Window.partitionBy(*position))
    out = out.withColumn("_usual", F.when(whole, usual))
    wrong = truthy(F.col("_s_FV") == F.col("_s_COST")) & _within(F.try_divide(F.abs("FV"), F.col("_usual")), IN_LINE) & _within(F.abs(F.try_divide(F.col("FV"), par * F.col("_s_FV"))), IN_LINE)
    out = out.withColumn("_wrong", wrong)
    changed = {"PAR": F.when(F.col("_wrong"), par * F.col("_s_FV")).otherwise(par), "PAR_scale_flag": F.when(F.col("_wrong"), F.concat(F.lit("mul"), F.col("_s_FV").cast("string"))).otherwise(F.col("PAR_scale_flag"))}
    for c in ("FV", "COST"):
        changed[c] = F.when(F.col("_wrong") | F.col(f"_s_{c}").isNull(), F.col(c)).otherwise(F.col(c) / F.col(f"_s_{c}"))
        changed[f"{c}_scale_flag"] = F.when(F.col("_wrong"), "unchanged").otherwise(F.col(f"{c}_scale_flag"))
    out = out.withColumns(changed).drop("_usual", "_wrong", "_s_FV", "_s_COST")

    cost, fv, flag = F.col("COST"), F.col("FV"), F.col("PAR_scale_flag")
    large = truthy(F.abs(cost) >= LARGE_COST)
    out = out.withColumn("_s", F.when(large, _landing(F.try_divide(par, cost), CLOSE)))
    out = out.withColumns({"PAR": par / F.coalesce("_s", F.lit(1)), "PAR_scale_flag": F.when(F.col("_s").isNotNull(), F.concat(F.lit("div"), F.col("_s").cast("string"))).otherwise(flag)}).drop("_s")
    usual = F.median(F.when(par > 0, par)).over(Window.partitionBy("cik", "cal_q"))
    out = out.withColumn("_usual", usual)
    tiny = ~large & truthy(cost > 0) & _within(F.try_divide(par, cost) / 1000, EXACT) & _within(F.try_divide(fv, cost), CLOSE) & truthy(par > TYPICAL_SIZES * F.col("_usual"))
    out = out.withColumn("_tiny", tiny)
    out = out.withColumns({"PAR": F.when(F.col("_tiny"), par / 1000).otherwise(par), "PAR_scale_flag": F.when(F.col("_tiny"), "div1000").otherwise(flag)}).drop("_usual", "_tiny")

    small = {c: truthy(F.col(other) > 0) & _within(F.try_divide(par, F.col(other)), CLOSE) & _within(F.try_divide(F.col(c) * 1000, F.col(other)), EXACT) for c, other in (("FV", "COST"), ("COST", "FV"))}
    out = out.withColumns({f"_small_{c}": test for c, test in small.items()})
    for c in small:
        hit = F.col(f"_small_{c}")
        out = out.withColumns({c: F.when(hit, F.col(c) * 1000).otherwise(F.col(c)), f"{c}_scale_flag": F.when(hit, "mul1000").otherwise(F.col(f"{c}_scale_flag"))})
    return out.withColumn("PAR_scale_flag", F.coalesce("filing_flag", "PAR_scale_flag")).drop("_small_FV", "_small_COST", "filing_flag")
