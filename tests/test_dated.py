import pytest

from sylva.plans import dated, typed
from sylva.plans.evaluate import evaluate
from sylva.functions.items import item_value
from sylva.sources.parsers import parse

ROWS = [(1, "2024-02-29", "2024-02-29T10:05:07", "P1DT2H3M4.5S", "P1Y2M"), (2, "1999-12-31", "1999-12-31T23:59:59.25", "-PT90M", "-P14M"), (3, "2000-01-01", "2000-01-01T00:00:00", "PT0S", "P0M"), (4, "1995-06-17", "2010-07-04T12:30:00", "P400D", "P25Y")]
EXPRESSIONS = [
    "xs:date(d)", "year-from-date(xs:date(d))", "month-from-date(xs:date(d))", "day-from-date(xs:date(d))", "xs:date(d) + xs:dayTimeDuration('P40D')", "xs:date(d) - xs:dayTimeDuration('PT36H')", "xs:date(d) + xs:yearMonthDuration('P1M')", "xs:date(d) - xs:yearMonthDuration('P1Y')",
    "xs:date(d) - xs:date('1992-01-01')", "days-from-duration(xs:date(d) - xs:date('1992-01-01'))", "xs:date(d) > xs:date('1995-06-17')", "xs:date(d) = xs:date('2000-01-01')", "format-date(xs:date(d), '[D01].[M01].[Y0001]')", "format-date(xs:date(d), '[D] [MNn] [Y]')",
    "xs:dateTime(t)", "hours-from-dateTime(xs:dateTime(t))", "minutes-from-dateTime(xs:dateTime(t))", "seconds-from-dateTime(xs:dateTime(t))", "xs:dateTime(t) + xs:dayTimeDuration(s)", "xs:dateTime(t) - xs:dateTime('2000-01-01T00:00:00')", "format-dateTime(xs:dateTime(t), '[H01]:[m01]:[s01]')",
    "xs:dayTimeDuration(s)", "days-from-duration(xs:dayTimeDuration(s))", "hours-from-duration(xs:dayTimeDuration(s))", "minutes-from-duration(xs:dayTimeDuration(s))", "xs:dayTimeDuration(s) + xs:dayTimeDuration('P1D')", "xs:dayTimeDuration(s) * 2", "xs:yearMonthDuration(m)", "years-from-duration(xs:yearMonthDuration(m))", "months-from-duration(xs:yearMonthDuration(m))", "xs:yearMonthDuration(m) + xs:yearMonthDuration('P1M')",
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "k int, d string, t string, s string, m string")


def test_equal_to_the_interpreter(rows):
    got = {r["k"]: r for r in rows.select("k", *[typed.column(rows, f"string({x})").alias(f"c{k}") for k, x in enumerate(EXPRESSIONS)]).collect()}
    for k, *values in ROWS:
        tree = parse("".join(f'{{"{n}": "{v}"' if n == "d" else f', "{n}": "{v}"' for n, v in zip("dtsm", values, strict=True)) + "}", "json")
        for j, x in enumerate(EXPRESSIONS):
            deep = x
            for n in "dtsm":
                deep = deep.replace(f"({n})", f"(//{n})")
            assert got[k][f"c{j}"] == item_value(evaluate(f"string({deep})", tree)[0], quoted=False), (x, values)


def test_no_python(rows):
    plan = rows.select(typed.column(rows, "xs:date(d) + xs:dayTimeDuration('P1D')"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_texts_that_are_no_dates_are_null(spark):
    df = spark.createDataFrame([("2024-13-01",), ("x",), ("2024-1-1",), (None,), ("",), ("P",), ("PT",)], "d string")
    for x in ("xs:date(d)", "xs:dateTime(d)", "xs:dayTimeDuration(d)", "xs:yearMonthDuration(d)"):
        assert df.select(typed.column(df, x).isNull().alias("n")).where("not n").count() == 0


def test_pictures():
    assert dated.pattern("[Y0001]-[M01]") == "yyyy'-'MM" and dated.pattern("[D]. [MNn]") == "d'. 'MMMM" and dated.pattern("[Z]") is None and dated.pattern("it's [[[Y]") == "'it''s ['y"


def test_what_does_not_combine(rows):
    for x in ("xs:date(d) + 1", "xs:date(d) * 2", "year-from-date(k)", "format-date(xs:date(d), '[Z]')", "days-from-duration(xs:date(d))"):
        with pytest.raises(typed.Unsupported):
            typed.column(rows, x)
