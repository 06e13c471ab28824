"""Rate scales and the ordered rules that settle a loan's total, cash, in-kind rate and spread."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.semantics import append_tag, close, nz, truthy

TOLERANCE, BASE_TOLERANCE = 1e-6, 0.005
MOST_RATE = 0.50
SPREAD_LIKE = (0.02, 0.09)
PRIME_OVER_BASE = 0.032
SCALES = (100, 10_000)


def rescale(x: Column, low: float, high: float, scales: Sequence[int] = SCALES) -> tuple[Column, Column]:
    """``x`` brought into a band by the scale that lands nearest its middle; and what was done: unchanged, divN, unresolved or na."""
    size, middle = F.abs(x), (low + high) / 2

    def landing(s: int) -> Column:
        inside = (size / s).between(low, high)
        return F.when(inside, F.struct(F.abs(size / s - middle).alias("distance"), F.lit(s).alias("scale")))

    best = F.array_min(F.array_compact(F.array(*[landing(s) for s in scales])))["scale"]
    fits = size.between(low, high)
    value = F.when(fits, x).otherwise(F.coalesce(x / best, x))
    done = F.when(x.isNull(), "na").when(fits, "unchanged").when(best.isNotNull(), F.concat(F.lit("div"), best.cast("string"))).otherwise("unresolved")
    return value, done


def rescale_rates(rows: DataFrame, bands: dict[str, tuple[float, float]], unsigned: Sequence[str] = ()) -> DataFrame:
    """``<rate>_normalized`` and ``<rate>_scale_flag`` of each rate; those in ``unsigned`` lose a minus sign and say so."""
    new = {}
    for name, (low, high) in bands.items():
        value, done = rescale(F.col(name), low, high)
        if name in unsigned:
            done = F.when(truthy(value < 0), F.concat(done, F.lit("|sign_error"))).otherwise(done)
            value = F.abs(value)
        new |= {f"{name}_normalized": value, f"{name}_scale_flag": done}
    return rows.withColumns(new)


def rate_config(rate: str = "rate", spread: str = "spread", pik: str = "pik", pic: str = "pic") -> Column:
    """Which of spread, rate, pik and pic a row reports, as a list; ``none`` if it reports none."""
    names = {"spread": spread, "rate": rate, "pik": pik, "pic": pic}
    text = F.concat_ws(", ", *[F.when(F.col(c).isNotNull(), F.lit(n)) for n, c in names.items()])
    return F.when(text == "", "none").otherwise(text)


@dataclass(frozen=True)
class Rule:
    """Where ``when`` holds, ``writes`` are assigned together and the tag is kept; ``moves_rate``: the reported rate was another field."""

    tag: str
    when: Callable[[], Column]
    writes: dict[str, Callable[[], Column]]
    moves_rate: bool = False



def _c(name: str) -> Column:
    return F.col(name)


def known(*names: str) -> Column:
    return reduce(lambda a, b: a & b, [_c(n).isNotNull() for n in names])


def absent(*names: str) -> Column:
    return reduce(lambda a, b: a & b, [_c(n).isNull() for n in names])


def components() -> Column:
    return nz(_c("pic")) + nz(_c("pik"))


def estimate() -> Column:
    """Base plus spread; a floor below the spread lifts the base, one at or above it is a least total."""
    plain = _c("base") + _c("spread")
    lifts = truthy(_c("floor") < _c("spread"))
    return (
        F.when(lifts & truthy(_c("floor") > _c("base")), _c("floor") + _c("spread"))
        .when(~lifts & truthy(_c("floor") > plain), _c("floor"))
        .otherwise(plain)
    )


def _live() -> Column:
    return ~_c("is_zero")


def _fixed(value: bool) -> Column:
    return truthy(_c("is_fixed") == value)


def _null() -> Column:
    return F.lit(None).cast("double")


def _yes() -> Column:
    return F.lit(True)


def rate_rules() -> list[Rule]:
    """The sixteen rules in order; each sees what those before it wrote."""
    r, s, k, p = (lambda: _c("rate")), (lambda: _c("spread")), (lambda: _c("pik")), (lambda: _c("pic"))
    both = lambda: _c("rate") + _c("pik")
    same = lambda: close(_c("rate"), _c("spread"))
    spread_like = lambda: truthy((_c("rate") > SPREAD_LIKE[0]) & (_c("rate") <= SPREAD_LIKE[1]))
    some = lambda: _c("pic").isNotNull() | _c("pik").isNotNull()
    t = TOLERANCE
    return [
        Rule("fixed_spread_is_rate", lambda: _fixed(True) & absent("rate", "pic", "pik") & known("spread"), {"rate": s, "spread": _null}, True),
        Rule("rate_is_spread_floating", lambda: _fixed(False) & _live() & same() & known("base"), {"rate": estimate, "estimated": _yes}, True),
        Rule(
            "rate_is_spread_untagged",
            lambda: absent("is_fixed") & _live() & same() & spread_like() & known("base"),
            {"rate": estimate, "estimated": _yes},
            True,
        ),
        Rule("clear_spread_untagged_coupon", lambda: absent("is_fixed") & _live() & same() & (_c("rate") > SPREAD_LIKE[1]), {"spread": _null}),
        Rule(
            "spread_is_allin_rate",
            lambda: _live() & absent("rate") & known("spread") & some() & close(_c("spread"), components()),
            {"rate": s, "spread": _null},
            True,
        ),
        Rule(
            "rate_is_spread",
            lambda: _live() & (_c("rate") < _c("pic") - t) & (components() <= MOST_RATE),
            {"spread": lambda: F.coalesce("spread", F.when(_c("rate") > 0, _c("rate"))), "rate": components},
            True,
        ),
        Rule(
            "pic_is_spread",
            lambda: _live() & known("rate", "pic") & absent("spread", "pik") & close(_c("rate") - _c("pic"), _c("base"), BASE_TOLERANCE),
            {"spread": p, "pic": r},
        ),
        Rule(
            "rate_is_spread_components_exceed",
            lambda: _live() & known("rate", "pic", "pik") & absent("spread") & (components() > _c("rate") + t),
            {"spread": r, "rate": components},
            True,
        ),
        Rule(
            "rate_is_cash_component",
            lambda: _live() & absent("pic") & (_c("pik") > _c("rate") + t) & (both() <= MOST_RATE),
            {"pic": r, "rate": both},
            True,
        ),
        Rule(
            "rate_below_spread_replaced",
            lambda: _live() & absent("pic", "pik") & (_c("rate") < _c("spread") - t) & known("base"),
            {"rate": estimate, "estimated": _yes},
        ),
        Rule(
            "rate_from_base_plus_spread_plus_pik",
            lambda: _live() & absent("rate", "pic") & (_c("pik") > _c("spread") + t) & (_c("pik") < _c("base") - t),
            {"rate": lambda: estimate() + _c("pik"), "pic": estimate, "estimated": _yes},
        ),
        Rule(
            "rate_from_components",
            lambda: _live() & absent("rate") & some() & (_c("spread").isNull() | (components() > _c("spread") + t)) & (components() <= MOST_RATE),
            {"rate": components},
        ),
        Rule("rate_from_base_plus_spread", lambda: _live() & absent("rate") & known("spread", "base"), {"rate": estimate, "estimated": _yes}),
        Rule(
            "rate_is_cash_part_of_base_plus_spread",
            lambda: _live()
            & known("rate", "spread", "base")
            & absent("pic")
            & (_c("pik") > 0)
            & close(both(), estimate(), BASE_TOLERANCE)
            & ~close(_c("rate"), estimate(), BASE_TOLERANCE),
            {"pic": r, "rate": both},
            True,
        ),
        Rule(
            "pic_from_rate_minus_pik",
            lambda: _live() & absent("pic") & (_c("pik") <= _c("rate") + t),
            {"pic": lambda: F.greatest(_c("rate") - _c("pik"), F.lit(0.0))},
        ),
        Rule(
            "pic_from_rate_minus_pik_reconcile",
            lambda: _live() & known("rate", "pic", "pik") & ~close(components(), _c("rate")) & (_c("pik") <= _c("rate") + t),
            {"pic": lambda: _c("rate") - _c("pik")},
        ),
    ]


def apply_rules(rows: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """``rows`` after each rule in turn; a rule is one projection that reads the state before it.

    Expects ``rate, spread, pik, pic, base, floor, is_fixed, is_zero, estimated, moved, tags``.
    """
    for rule in rules or rate_rules():
        hit = truthy(rule.when())
        marked = rows.withColumn("_hit", hit)
        new = {c: F.when(F.col("_hit"), write()).otherwise(F.col(c)) for c, write in rule.writes.items()}
        new["tags"] = append_tag(F.col("tags"), F.col("_hit"), rule.tag)
        if rule.moves_rate:
            new["moved"] = F.col("moved") | F.col("_hit")
        rows = marked.withColumns(new).drop("_hit")
    return rows


def resolve_rates(rows: DataFrame, base_rates: DataFrame | None = None, drop_empty: bool = True) -> DataFrame:
    """Rates settled by the rules, with ``rate_source`` and checks of the two identities.

    ``base_rates``: ``(cal_q, currency, base)``; missing currencies have none.
    The base is floored at 0, prime loans in USD add 3.2 points, fixed loans have
    none.  ``check_components``: rate = pic + pik; ``reported`` lists what the row reported.
    """
    out = rows.withColumn("reported", rate_config())
    if drop_empty:
        out = out.where("reported <> 'none'")
    if base_rates is not None:
        out = out.join(base_rates, ["cal_q", "currency"], "left")
    prime = F.when(F.col("is_prime") & (F.col("currency") == "USD"), F.lit(PRIME_OVER_BASE)).otherwise(F.lit(0.0))
    base = F.when(~_fixed(True), F.greatest(F.col("base"), F.lit(0.0)) + prime)
    out = out.withColumn("base", F.when(F.col("base").isNotNull(), base))
    out = out.withColumns(
        {
            "is_zero": truthy(F.col("rate") == 0) & (components() == 0),
            "estimated": F.lit(False),
            "moved": F.lit(False),
            "tags": F.lit(""),
            "rate_was": F.col("rate"),
        }
    )
    out = apply_rules(out)
    source = (
        F.when(F.col("rate").isNull(), "none")
        .when(F.col("is_zero"), "zero")
        .when(F.col("estimated"), "estimated")
        .when(F.col("rate_was").isNotNull() & ~F.col("moved"), "reported")
        .otherwise("derived")
    )
    return out.withColumns({"rate_source": source, "check_components": close(F.col("rate"), components())})
