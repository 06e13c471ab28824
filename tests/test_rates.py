import pytest

from quillon.operators import rates

N = None
FIELDS = ("rate", "spread", "pik", "pic", "base", "floor", "is_fixed")
#: One row a rule: what is reported, and rate, spread, pic after all rules, with the tag that must be first.
CASES = {
    "fixed_spread_is_rate": ((N, 0.10, N, N, N, N, True), (0.10, N, N)),
    "rate_is_spread_floating": ((0.06, 0.06, N, N, 0.05, N, False), (0.11, 0.06, N)),
    "rate_is_spread_untagged": ((0.06, 0.06, N, N, 0.05, N, N), (0.11, 0.06, N)),
    "clear_spread_untagged_coupon": ((0.12, 0.12, N, N, 0.05, N, N), (0.12, N, N)),
    "spread_is_allin_rate": ((N, 0.12, 0.02, 0.10, 0.05, N, N), (0.12, N, 0.10)),
    "rate_is_spread": ((0.05, N, 0.01, 0.09, 0.05, N, N), (0.10, 0.05, 0.09)),
    "pic_is_spread": ((0.11, N, N, 0.06, 0.05, N, N), (0.11, 0.06, 0.11)),
    "rate_is_spread_components_exceed": ((0.06, N, 0.05, 0.05, 0.05, N, N), (0.10, 0.06, 0.05)),
    "rate_is_cash_component": ((0.03, N, 0.08, N, N, N, N), (0.11, N, 0.03)),
    "rate_below_spread_replaced": ((0.03, 0.06, N, N, 0.05, N, N), (0.11, 0.06, N)),
    "rate_from_base_plus_spread_plus_pik": ((N, 0.02, 0.03, N, 0.05, N, N), (0.10, 0.02, 0.07)),
    "rate_from_components": ((N, N, 0.02, 0.08, N, N, N), (0.10, N, 0.08)),
    "rate_from_base_plus_spread": ((N, 0.06, N, N, 0.05, N, N), (0.11, 0.06, N)),
    "rate_is_cash_part_of_base_plus_spread": ((0.08, 0.06, 0.03, N, 0.05, N, N), (0.11, 0.06, 0.08)),
    "pic_from_rate_minus_pik": ((0.11, N, 0.03, N, N, N, N), (0.11, N, 0.08)),
    "pic_from_rate_minus_pik_reconcile": ((0.11, 0.06, 0.03, 0.05, N, N, N), (0.11, 0.06, 0.08)),
}


@pytest.fixture(scope="module")
def settled(spark):
    rows = [(tag, *values, False, "USD") for tag, (values, _) in CASES.items()]
    rows += [("prime", N, 0.06, N, N, 0.05, N, N, True, "USD"), ("negative base", N, 0.06, N, N, -0.01, N, N, False, "EUR"), ("nothing", N, N, N, N, 0.05, N, N, False, "USD")]
    rows += [("floor lifts base", N, 0.06, N, N, 0.01, 0.02, N, False, "USD"), ("floor is least total", N, 0.02, N, N, 0.01, 0.08, N, False, "USD"), ("zero", 0.0, N, N, 0.0, 0.05, N, N, False, "USD")]
    schema = "tag string, rate double, spread double, pik double, pic double, base double, floor double, is_fixed boolean, is_prime boolean, currency string"
    return {r.tag: r for r in rates.resolve_rates(spark.createDataFrame(rows, schema)).collect()}


@pytest.mark.parametrize("tag", list(CASES))
def test_each_rule(settled, tag):
    got = settled[tag]
    assert got.tags.split("|")[0] == tag
    for value, want in zip((got.rate, got.spread, got.pic), CASES[tag][1], strict=True):
        assert value == (want if want is None else pytest.approx(want))


def test_every_rule_has_a_case():
    assert [r.tag for r in rates.rate_rules()] == list(CASES)


def test_base_floor_and_source(settled):
    assert settled["prime"].rate == pytest.approx(0.142) and settled["negative base"].rate == pytest.approx(0.06)
    assert settled["floor lifts base"].rate == pytest.approx(0.08) and settled["floor is least total"].rate == pytest.approx(0.08)
    assert "nothing" not in settled and settled["zero"].rate_source == "zero"
    sources = {t: settled[t].rate_source for t in ("rate_from_components", "rate_from_base_plus_spread", "pic_from_rate_minus_pik", "rate_is_cash_component")}
    assert list(sources.values()) == ["derived", "estimated", "reported", "derived"]
    assert settled["pic_from_rate_minus_pik"].check_components and not settled["prime"].check_components


def test_rescaled_rates(spark):
    rows = spark.createDataFrame([(12.5, -0.03), (0.12, 250.0), (1250.0, N), (0.001, 0.02), (N, -300.0)], "ir double, pik double")
    got = rates.rescale_rates(rows, {"ir": (0.02, 0.5), "pik": (0.0, 0.2)}, ("pik",)).collect()
    assert [r.ir_normalized for r in got] == [0.125, 0.12, 0.125, 0.001, N] and [r.ir_scale_flag for r in got] == ["div100", "unchanged", "div10000", "unresolved", "na"]
    assert got[0].pik_normalized == 0.03 and got[0].pik_scale_flag == "unchanged|sign_error" and got[4].pik_normalized == 0.03
