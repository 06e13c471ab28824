import datetime as dt
import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import EDGES

from quillon.llm.pii import KINDS, PATTERNS, Feistel, Pseudonyms, find, pseudonymize, valid

KEY = b"a test key"
VALUES = [
    ("email", "bo.b+x_1@mail-8.example.com"),
    ("card", "4111 1111 1111 1111"),
    ("card", "4785380592391139"),
    ("ssn", "123-45-6789"),
    ("phone", "+1 (988) 555-2485"),
    ("phone", "(020) 7946-0958"),
    ("date", "2024-02-29"),
    ("date", "31/12/1999"),
    ("ip", "70.123.182.155"),
    ("iban", "DE89 3704 0044 0532 0130 00"),
    ("iban", "GB82WEST12345698765432"),
]


@given(st.integers(1, 10**18), st.data())
@settings(max_examples=200, deadline=None)
def test_permutation_goes_back(n, data):
    x = data.draw(st.integers(0, n - 1))
    cipher = Feistel(KEY)
    y = cipher.permute(x, n, "t")
    assert 0 <= y < n and cipher.restore(y, n, "t") == x


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1024])
def test_permutation_hits_every_value(n):
    assert sorted(Feistel(KEY).permute(i, n, "t") for i in range(n)) == list(range(n))


@pytest.mark.parametrize(("kind", "text"), VALUES)
def test_form_is_kept(kind, text):
    new = Pseudonyms(KEY).of(kind, text)
    assert new != text and len(new) == len(text) or kind == "ip"
    assert valid(kind, new) and Pseudonyms(KEY, back=True).of(kind, new) == text
    assert Pseudonyms(b"other").of(kind, text) != new
    assert [KINDS[k] for k, _, _ in find(f"<< {text} >>")] == [kind]


@pytest.mark.parametrize(
    "text", ["4785380592391138", "999.1.2.3", "2024-02-30", "000-12-3456", "DE88 3704 0044 0532 0130 00", "v1.2.3", "a@b", "12 34", "+1", "1.2.3.4.5"]
)
def test_invalid_values_are_left(docs_of, text):
    assert pseudonymize(docs_of([(1, f"see {text} there")]), KEY).first().text == f"see {text} there"


def test_equal_values_stay_linked(docs_of):
    rows = [(i, f"{'é ' * i}mail bosbt.42@mail8.example.com, card 4785380592391139$$$ from 70.123.182.155### on 2024-01-02.") for i in range(5)]
    got = sorted(pseudonymize(docs_of(rows), KEY).collect(), key=lambda r: r.doc_id)
    assert len({r.text.lstrip("é ") for r in got}) == 1
    assert not any(v in r.text for r in got for v in ("bosbt.42", "4785380592391139", "70.123.182.155", "2024-01-02"))
    for (_, text), r in zip(rows, got, strict=True):
        assert r.n_private == 4
        assert [text[s["start"] : s["end"]][:4] for s in r.private_spans] == ["bosb", "4785", "70.1", "2024"]


def test_each_value_alone_in_a_text(docs_of):
    more = [("card", "4111-1111-1111-1111"), ("phone", "+44 20 7946 0958"), ("phone", "+1 415 555 2671"), ("phone", "+49 30 12 34 56"), ("ip", "1.2.3.4")]
    values = [*VALUES, *more]
    docs = docs_of([(i, f"on {v} now") for i, (_, v) in enumerate(values)])
    for r in pseudonymize(docs, KEY).collect():
        kind, value = values[r.doc_id]
        assert [(s["kind"], s["start"], s["end"]) for s in r.private_spans] == [(kind, 3, 3 + len(value))], value
        assert r.n_private == 1 and value not in r.text


def test_dates_are_permuted_within_their_form():
    there, back = Pseudonyms(KEY), Pseudonyms(KEY, back=True)
    days = [dt.date(1990, 1, 1) + dt.timedelta(days=i) for i in range(365 * 20 + 5)]
    values = sorted({d.strftime(f) for d in days for f in ("%d/%m/%Y", "%m/%d/%Y")})
    new = [there.of("date", v) for v in values]
    assert len(set(new)) == len(values)
    assert [back.of("date", v) for v in new] == values


def test_grouping_of_a_telephone_number_does_not_matter():
    own = Pseudonyms(KEY)

    def digits(text):
        return re.sub("[^0-9]", "", own.of("phone", text))

    assert digits("(555) 123-4567") == digits("555-123-4567") == digits("555.123.4567")
    assert digits("+1 555 123 4567") == digits("+1 (555) 123-4567") == digits("+15551234567") == "1" + digits("555-123-4567")
    assert digits("+44 20 7946 0958")[:2] == "44" and digits("+380 44 123 4567")[:3] == "380"


def brute_find(text):
    """Every kind in order takes its matches that touch none taken before."""
    taken = []
    for k, kind in enumerate(KINDS):
        taken += [(k, *m.span()) for m in PATTERNS[kind].finditer(text) if valid(kind, m[0]) and all(m.end() <= s or m.start() >= e for _, s, e in taken)]
    return sorted(taken, key=lambda s: s[1])


@given(st.lists(st.one_of(st.sampled_from([v for _, v in VALUES]), st.text("0123456789 -./()+@ab", max_size=24)), max_size=12), st.sampled_from([" ", "", ", "]))
@settings(max_examples=300, deadline=None)
def test_find_equals_brute_force(parts, joint):
    text = joint.join(parts)
    assert find(text) == brute_find(text)


def test_many_values_in_one_text():
    text = " ".join(f"user{i}@mail{i % 7}.example.com 10.{i % 200}.3.{i % 250}" for i in range(40_000))
    began = time.perf_counter()
    assert len(find(text)) == 80_000 and time.perf_counter() - began < 20


def test_edges(docs_of):
    docs = docs_of([*EDGES, (8, "x" * 300_000 + " 4785380592391139")]).selectExpr("*", "1 AS _c0", "2 AS n_private", "map('a', 1) AS m")
    got = pseudonymize(docs, KEY)
    assert got.columns == [*[c for c in docs.columns if c != "n_private"], "private_spans", "n_private"]
    rows = got.collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in rows if r.doc_id != 8) == sorted((i or 0, t or "") for i, t in EDGES)
    assert [r.n_private for r in rows if r.doc_id == 8] == [1]
    assert pseudonymize(docs_of([]), KEY).count() == 0


# The published structures of some IBANs: n digits, a capitals, c either.
STRUCTURES = {
    "BE": "12n", "ES": "20n", "AT": "16n", "PL": "24n", "SE": "20n", "DE": "18n", "FR": "10n11c2n", "GB": "4a14n", "NO": "11n", "MT": "4a5n18c",
    "NL": "4a10n", "IT": "1a10n12c", "CH": "5n12c", "PT": "21n", "LC": "4a24c", "DK": "14n", "FI": "14n", "IE": "4a14n", "SA": "2n18c", "TR": "22n",
}


def make_iban(country, rng):
    body = "".join(
        rng.choice({"n": "0123456789", "a": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "c": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"}[kind])
        for n, kind in re.findall("([0-9]+)([nac])", STRUCTURES[country])
        for _ in range(int(n))
    )
    rest = 0
    for c in body + country + "00":  # remainder of the number, sign by sign
        rest = (rest * (10 if c.isdigit() else 100) + int(c, 36)) % 97
    return f"{country}{98 - rest:02d}{body}"


@pytest.mark.parametrize("country", STRUCTURES)
def test_ibans_of_each_country_before_any_text(country):
    rng = random.Random(country)
    for after in (" IN EUR", " OR", " AND", " 2024", " 12 times", ".", ",\n", " a", " AB12 CD34", ""):
        plain = make_iban(country, rng)
        for written in (plain, re.sub("(.{4})(?=.)", r"\1 ", plain)):
            text = f"Pay {written}{after}"
            found = find(text)
            assert (KINDS.index("iban"), 4, 4 + len(written)) in found and len(found) == 1, text
            new = Pseudonyms(KEY).of("iban", written)
            assert new[:2] == country and [x == " " for x in new] == [x == " " for x in written]
            n = new.replace(" ", "")
            rest = int("".join(str(int(c, 36)) for c in n[4:] + n[:4])) % 97
            assert rest == 1 and n == Pseudonyms(KEY).of("iban", plain)


@pytest.mark.parametrize("text", ["BE68 5390 0754 7034", "BE68539007547034", "ES91 2100 0418 4502 0005 1332", "SE45 5000 0000 0583 9825 7466", "BE51 2222 2222 2222"])
def test_published_ibans(text):
    assert [(KINDS[k], s, e) for k, s, e in find(f"Pay {text} IN EUR")] == [("iban", 4, 4 + len(text))]


def test_ungrouped_and_grouped_numbers_are_linked():
    """2,000 numbers with a country code and 11 more digits: no other kind, one pseudonym in each form."""
    rng = random.Random(4)
    own = Pseudonyms(KEY)
    seen = set()
    for _ in range(2000):
        d = "".join(rng.choice("0123456789") for _ in range(11))
        forms = [f"+49{d}", f"+49 {d[:3]} {d[3:7]} {d[7:]}", f"+49-{d[:4]}-{d[4:7]}-{d[7:]}", f"+49 {d[:3]} {d[3:5]} {d[5:7]} {d[7:9]} {d[9:]}"]
        assert all([(KINDS[k], s, e) for k, s, e in find(f"call {f} NOW")] == [("phone", 5, 5 + len(f))] for f in forms)
        new = {re.sub("[^0-9+]", "", own.of("phone", f)) for f in forms}
        assert len(new) == 1 and new.pop() not in seen
        seen |= new


def test_cards_behind_a_sign_that_is_no_country_code():
    assert [KINDS[k] for k, _, _ in find("+4111111111111111 and +1 4111 1111 1111 1111")] == ["card", "card"]
