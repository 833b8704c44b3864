"""Problem 1: the columnar path and the strict parser agree; each kind of breach has its reason."""

import random

import pytest

from millrace.operators import records as R

GOOD = "7,Ann,Lee,ALEE,1.2,2020-02-29,IT,10.5,,3,4"
PLACE = '9,"1 High Road, Unit 2",12345,Town,Shire,QM'


@pytest.mark.parametrize(
    ("feed", "line", "reason"),
    [
        ("db_employees", GOOD, None),
        ("db_employees", GOOD + "\r", None),
        ("db_employees", ' 7 ,"Ann",Lee,ALEE,1.2," 2020-02-29 ",IT, 10.5 ,,3,4', None),
    ("db_employees", GOOD.replace("Ann", '"Ann" '), "text_after_quote"),
    ("db_employees", GOOD.replace("Ann", ' "Ann"'), "text_before_quote"),
        ("db_employees", GOOD.replace("2020-02-29", "").replace("10.5", ""), None),
        ("db_employees", GOOD.replace("Ann", '"A ""x"" n\n,"'), None),
        ("db_employees", GOOD.replace("Ann", 'A"n'), "quote_inside_value"),
        ("db_employees", GOOD.replace("Ann", '"Ann"x'), "text_after_quote"),
        ("db_employees", GOOD.replace("Ann", '"Ann'), "unclosed_quote"),
        ("db_employees", GOOD.replace("Ann", "A\nn"), "line_break_outside_quotes"),
        ("db_employees", GOOD + "\r\r", "line_break_outside_quotes"),
        ("db_employees", GOOD + ",", "too_many_columns"),
        ("db_employees", "7,Ann", "too_few_columns"),
        ("db_employees", "", "too_few_columns"),
        ("db_employees", "x" + GOOD, "invalid_employee_id"),
        ("db_employees", "٧" + GOOD[1:], "invalid_employee_id"),
        ("db_employees", GOOD.replace("02-29", "02-30"), "invalid_hire_date"),
        ("db_employees", GOOD.replace("2020", "0000"), "invalid_hire_date"),
        ("db_employees", GOOD.replace("2020-02-29", "2020-2-29"), "invalid_hire_date"),
        ("db_employees", GOOD.replace("10.5", "10."), "invalid_salary"),
        ("db_employees", GOOD.replace("10.5", "-10"), "invalid_salary"),
        ("db_employees", GOOD.replace("10.5", "1e5"), "invalid_salary"),
        ("db_locations", PLACE, None),
        ("db_locations", PLACE.replace("1 High Road, Unit 2", "１ 町\n2"), None),
        ("db_locations", PLACE.replace("1 High Road, Unit 2", "12 34"), "invalid_street_address"),
        ("db_locations", PLACE.replace("High", "Hi\tgh"), "invalid_street_address"),
        ("db_locations", PLACE.replace("High", "Hi\ufffdgh"), "invalid_street_address"),
        ("db_locations", PLACE.replace("High", "Hi\x85gh"), "invalid_street_address"),
        (None, GOOD, "unknown_feed"),
        ("other", GOOD, "unknown_feed"),
        ("db_employees", None, "null_record"),
    ],
)
def test_reasons(spark, feed, line, reason):
    assert R.diagnose(line, feed)[1] == reason
    if feed in R.FEEDS and line is not None:
        # alone, and among many valid records on the columnar path
        import pyarrow as pa

        good = GOOD if feed == "db_employees" else PLACE
        lines = [good] * 300 + [line] + [good] * 300
        reasons = R._Feed(feed).parse(pa.array(lines))[1]
        assert reasons == [None] * 300 + [reason] + [None] * 300


def test_columnar_path_is_never_laxer():
    """Random damage: the block parser and the strict one find the same."""
    import pyarrow as pa

    rng = random.Random(5)
    for feed, good in (("db_employees", GOOD), ("db_locations", PLACE)):
        lines = []
        for _ in range(3000):
            line = list(good)
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                at = rng.randrange(len(line))
                line[at : at + rng.randint(0, 1)] = rng.choice(['"', ",", "\n", "\r", " ", "0", "", '""', "x", "\t"])
            lines.append("".join(line))
        values, reasons = R._Feed(feed).parse(pa.array(lines))
        for line, v, r in zip(lines, values, reasons):
            assert (v, r) == R.diagnose(line, feed), line


def test_frame(spark):
    rows = [(1, "db_employees", GOOD, "x"), (1, "db_employees", GOOD, "y"), (2, "db_locations", PLACE, None), (None, "db_locations", "bad", None), (4, None, None, None), (5, "db_locations", "1," + "a" * 300_000 + ",,,,", None)]
    df = spark.createDataFrame(rows, "record_id bigint, feed string, raw_line string, reason string")
    parsed = R.parse_records(df)
    assert sorted((r.record_id or 0, r.reason) for r in R.rejected(parsed).collect()) == [(0, "too_few_columns"), (4, "null_record")]
    typed = R.typed(parsed, "db_employees").collect()
    assert len(typed) == 2 and typed[0].salary == 10.5 and str(typed[0].hire_date) == "2020-02-29" and typed[0].commission_pct is None
    assert R.typed(parsed, "db_locations").count() == 2
    assert R.parse_records(df.limit(0)).count() == 0


def test_valid_records_between_bad_ones_are_loaded_columnar(monkeypatch):
    """A bad record in every few doesn't send the others to the strict parser."""
    import pyarrow as pa

    strict, seen = R.diagnose, []
    monkeypatch.setattr(R, "diagnose", lambda line, feed: seen.append(line) or strict(line, feed))
    bad = [GOOD.replace("02-29", "02-30"), GOOD + ",", GOOD.replace("Ann", 'A"n'), GOOD.replace("10.5", "1e5")]
    lines = [bad[i // 14 % 4] if i % 14 == 0 else GOOD for i in range(5000)]
    values, reasons = R._Feed("db_employees").parse(pa.array(lines))
    assert sorted(seen) == sorted(x for x in lines if x != GOOD)
    assert [(v, r) for v, r in zip(values, reasons)] == [strict(x, "db_employees") for x in lines]


def test_days():
    import pyarrow as pa

    days = [f"{y:04}-{m:02}-{d:02}" for y in (0, 1, 1900, 2000, 2023, 2024, 9999) for m in range(15) for d in (0, 1, 28, 29, 30, 31, 32, 99)]
    assert R._days(pa.array([*days, "", "2020-1-1", "x"])).tolist() == [*map(R._is_day, days), True, False, False]
