import pytest
from hypothesis import given
from hypothesis import strategies as st

from factloom.functions.amounts import UnitReader, numbers, readings
from factloom.operators.units import Converter, convert_quantities, measured_dimensions, read_quantities, thousandths

CATALOG = [("money EUR", "EUR", "m EUR", 1e-6), ("money EUR", "k EUR", "m EUR", 1e-3), ("money EUR", "m EUR", "m EUR", 1.0), ("money EUR", "bn EUR", "m EUR", 1000.0), ("distance", "m", "km", 0.001), ("distance", "km", "km", 1.0),
           ("distance", "nmi", "km", 1.852), ("share", "percent", "percent", 1.0), ("share", "permille", "percent", 0.1), ("duration", "year", "month", 12.0), ("boxes", "TEU", "TEU", 1.0), ("boxes", "kTEU", "TEU", 1000.0)]
DIMENSIONS = {"reportedrevenue": "money", "routelength": "distance", "margin": "share", "occursyearsafter": "duration", "cargovolume": "boxes"}


@pytest.mark.parametrize(("text", "value"), [("12.5", 12.5), ("1,234.5", 1234.5), ("4.767,00", 4767), ("1,689", 1689), ("12,5", 12.5), ("1.234.567", 1234567), ("5 200 500", 5200500), ("0.121", 0.121), ("637.953,00", 637953)])
def test_readings(text, value):
    assert readings(text)[0] == value


@pytest.mark.parametrize(("text", "value"), [("(4.06) bps", -4.06), ("−346.3", -346.3), ("9.5491e4", 95491), ("c. 28.45", 28.45), ("€1.93035e5k", 193035), ("Q3 12", 12), ("573.3'", 573.3)])
def test_numbers(text, value):
    assert numbers(text)[0].readings[0] == pytest.approx(value)


@given(st.integers(0, 10**12))
def test_grouping_changes_nothing(n):
    assert readings(f"{n:,}")[0] == n


@given(st.text(max_size=40))
def test_any_text_is_read(text):
    numbers(text)
    UnitReader(["EUR", "m", "km"]).alone(text)


@pytest.mark.parametrize(
    ("row", "expected"),
    [
        (("reportedrevenue", "0.1461", "bn", "0.1461 € bn"), ("m EUR", 146.1)), (("reportedrevenue", "+397.3", None, "put at €+397.3M in Q3 2022"), ("m EUR", 397.3)), (("reportedrevenue", "250", "'000 EUR", None), ("m EUR", 0.25)),
        (("routelength", "812406", "m", "812406 m"), ("km", 812.406)), (("routelength", "1.241,00 NM", "-", "x"), ("km", 1241 * 1.852)), (("margin", "15.55", "‰", None), ("percent", 1.555)), (("occursyearsafter", "51", "yrs", "Ann Lee"), ("month", 612)),
        (("cargovolume", "25.43 k TEU", "-", ""), ("TEU", 25430)), (("reportedrevenue", "12", None, "figure in 2020"), None), (("reportedrevenue", "see note 4", "m EUR", "3 m EUR"), None), (("reportedrevenue", "5", "km", "x"), None), (("other", "5", "m EUR", "x"), None),
        (("reportedrevenue", None, "m EUR", "x"), None),
    ],
)
def test_convert(row, expected):
    found = Converter(CATALOG).convert(*row[1:]).get(DIMENSIONS.get(row[0], ""))
    assert (found is None) == (expected is None)
    if expected:
        assert (found[0], pytest.approx(found[1])) == expected


def test_residual_picks_the_reading_that_the_object_confirms():
    c = Converter(CATALOG)
    assert c.convert("637.953", "m", "637,953 m")["distance"][1] == pytest.approx(637.953)
    assert len(c.convert("637.953", "m", None)["distance"][3]) == 1  # two readings, nothing to decide by


def test_residual_picks_scale_and_unit_that_the_columns_share():
    c, blind = Converter(CATALOG), Converter(CATALOG, use_residuals=False)
    assert c.convert("0.5", "bn", "0.5 bn EUR")["money"][1] == pytest.approx(500)
    assert blind.convert("0.5", "bn", "0.5 bn EUR")["money"][1] != pytest.approx(500)
    # value and unit disagree; the object sides with the unit
    assert c.convert("3 km", "nmi", "3 nautical miles")["distance"][1] == pytest.approx(3 * 1.852)
    assert c.convert("3 km", "nmi", None)["distance"][3]  # a tie


KIND = "seq long, subject string, predicate string, object string, value string, unit string, timeframe string, extra int"


def test_convert_quantities(spark):
    rows = [(1, "a", "Reported-Revenue!", "x", "2", "m EUR", None, 1), (1, "a", "reported_revenue", "x", "2", "m EUR", None, 1), (2, None, None, None, None, None, None, None), (3, "a", "route_length", "", "", "", "", 1), (4, "a", "route_length", "9" * 5000, "7", "km", "", 1)]
    catalog = spark.createDataFrame(CATALOG, "dimension string, unit_code string, common_unit string, factor double")
    found = thousandths(convert_quantities(spark.createDataFrame(rows, KIND), catalog)).collect()
    assert sorted(map(tuple, found)) == [(1, "m EUR", 2000), (1, "m EUR", 2000), (4, "km", 7000)]
    assert convert_quantities(spark.createDataFrame([], KIND), catalog).count() == 0


def test_the_facts_tell_what_a_predicate_measures(spark):
    rows = [(1, "a", "pier", "", "2", "km", "", 1), (2, "a", "pier", "", "3", "m", "", 1), (3, "a", "pier", "", "3", "EUR", "", 1), (4, "a", "toll", "", "3 m", "EUR", "", 1)]
    catalog = spark.createDataFrame(CATALOG, "dimension string, unit_code string, common_unit string, factor double")
    facts = spark.createDataFrame(rows, KIND)
    assert sorted(map(tuple, measured_dimensions(read_quantities(facts, catalog)).collect())) == [("pier", "distance"), ("toll", "money")]
    assert sorted(r["seq"] for r in convert_quantities(facts, catalog).collect()) == [1, 2, 4]


def test_a_product_identity_decides_a_tie(spark):
    """1.234 m EUR may be 1,234; a margin of 10 % and a profit of 123.4 m EUR say that it is."""
    rows = [
        (1, "a", "reported_revenue", "", "1.234", "m EUR", "2020", 1), (2, "a", "reported_margin", "", "10", "percent", "2020", 1), (3, "A.", "reported_profit", "", "123.4", "m EUR", "2020", 1),
        (4, "b", "reported_revenue", "", "1.234", "m EUR", "2020", 1), (5, "c", "reported_revenue", "", "1.234", "m EUR", "2021", 1), (6, "c", "reported_margin", "", "10", "percent", "2021", 1),
        (7, "c", "reported_profit", "", "123.4", "m EUR", "2021", 1), (8, "c", "reported_profit", "", "99", "m EUR", "2021", 1),
    ]
    catalog = spark.createDataFrame(CATALOG, "dimension string, unit_code string, common_unit string, factor double")
    found = {r["seq"]: (r["amount"], r["is_unique"]) for r in convert_quantities(spark.createDataFrame(rows, KIND), catalog).collect()}
    assert found[1] == (1234.0, True)
    assert found[4] == (1.234, False)  # nothing to decide by: flagged
    assert found[5] == (1.234, False)  # two profits
    assert len(found) == 8
