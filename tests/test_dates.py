"""Patterns of date strings inferred from shapes, parses by them, and texts that come back."""

import datetime as dt
import random
import warnings

import pytest

from tessella.errors import InvalidDataError
from tessella.functions import date_shapes, dates
from tessella.operators.temporal import OptimizedTimestampEncoder, UnixTimestampEncoder

EPOCH = dt.datetime(1970, 1, 1)
WHEN = [dt.datetime(2020, 1, 5, 15, 4), dt.datetime(1999, 12, 25, 0, 30), dt.datetime(2031, 5, 14, 12, 0), dt.datetime(1971, 10, 9, 9, 59)]


def frame(spark, values, kind="string"):
    return spark.createDataFrame(list(enumerate(values)), f"k long, x {kind}")


def column(df, name="x"):
    return [r[name] for r in df.orderBy("k").collect()]


def seconds(d):
    return (d - EPOCH) // dt.timedelta(microseconds=1) * 1000.0


#: A pattern, the smallest part of a time that it keeps, and the pattern found if it is another.
FORMS = [
    ("%d.%m.%Y", "day"), ("%-m/%-d/%Y %-I:%M %p", "minute"), ("%A, %B %-d, %Y", "day"), ("%Y%m%dT%H%M%S", "minute"), ("%m/%d/%Y", "day"), ("%Y-%m-%d", "day"), ("%Y/%m/%d %H:%M:%S", "minute"), ("%d-%b-%Y", "day"), ("%b %d, %Y", "day"),
    ("%d %B %Y %H:%M", "minute"), ("%a %d %b %Y", "day"), ("%Y%m%d", "day"), ("%d%b%Y", "day"), ("%Y-%m-%d %H:%M:%S.%f", "minute"), ("%Y%m%d%H%M%S", "minute"), ("%Y-%j", "day"), ("%-d.%-m.%y", "day"), ("%I:%M %p on %d %b %Y", "minute"), ("%B %d, %Y at %-I:%M %p", "minute"),
]


@pytest.mark.parametrize(("pattern", "unit"), FORMS)
def test_forms_are_inferred_and_come_back(spark, pattern, unit):
    values = [d.replace(hour=0, minute=0) if unit == "day" else d for d in WHEN]
    texts = [d.strftime(pattern) for d in values]
    t = UnixTimestampEncoder(missing_value_generation=None)
    made = t.fit_transform(frame(spark, [*texts, None]), "x", "k")
    assert t.datetime_format == pattern
    assert column(made)[:-1] == [seconds(d) for d in values]
    assert column(t.reverse_transform(made))[:-1] == texts


@pytest.mark.parametrize(
    ("texts", "first"),
    [
        (["2020-01-05T10:00:00.123Z", "2021-02-05T23:59:59.007Z"], dt.datetime(2020, 1, 5, 10, 0, 0, 123000)),
        (["2020-01-05 10:00:00+02:00", "2020-01-06 10:00:00+02:00"], dt.datetime(2020, 1, 5, 8)),
        (["2020-01-05T10:00:00-0330", "2020-07-06T10:00:00-0330"], dt.datetime(2020, 1, 5, 13, 30)),
        (["2020-01-05 10:00:00+02", "2020-01-06 10:00:00+02"], dt.datetime(2020, 1, 5, 8)),
        (["2020-01-05 10:00 UTC"], dt.datetime(2020, 1, 5, 10)),
        (["2020-07-05 10:00:00 Europe/Berlin", "2020-01-05 10:00:00 Europe/Berlin"], dt.datetime(2020, 7, 5, 8)),
        (["05-JAN-2020 7:05:09.5 pm", "25-DEC-1999 11:00:00.0 am"], dt.datetime(2020, 1, 5, 19, 5, 9, 500000)),
        (["1/5/70", "12/31/68"], dt.datetime(1970, 1, 5)),
        (["20/5/2020", "1/12/2021"], dt.datetime(2020, 5, 20)),
        (["12:30 2020-01-05"], dt.datetime(2020, 1, 5, 12, 30)),
        (["2020"], dt.datetime(2020, 1, 1)),
        (["Jan 2020", "May 2021"], dt.datetime(2020, 1, 1)),
        (["May 2020", "March 2021"], dt.datetime(2020, 5, 1)),
        (["2020-13-01", "2020-02-01"], dt.datetime(2020, 1, 13)),
    ],
)
def test_zones_halves_and_orders(spark, texts, first):
    t = UnixTimestampEncoder(missing_value_generation=None)
    made = t.fit_transform(frame(spark, texts), "x", "k")
    assert column(made)[0] == seconds(first)
    assert column(t.reverse_transform(made)) == texts


def test_years_of_two_digits(spark):
    t = UnixTimestampEncoder(datetime_format="%d.%m.%y", missing_value_generation=None)
    made = column(t.fit_transform(frame(spark, ["31.12.68", "01.01.69", "29.02.00", "31.12.99"]), "x", "k"))
    assert made == [seconds(d) for d in (dt.datetime(2068, 12, 31), dt.datetime(1969, 1, 1), dt.datetime(2000, 2, 29), dt.datetime(1999, 12, 31))]


@pytest.mark.parametrize("encoder", [UnixTimestampEncoder, OptimizedTimestampEncoder])
def test_a_column_of_mixed_forms(spark, encoder):
    rng = random.Random(4)
    days = [dt.datetime(1990, 1, 1) + dt.timedelta(days=rng.randrange(15000)) for _ in range(300)]
    patterns = ["%d.%m.%Y", "%-m/%-d/%Y", "%A, %B %-d, %Y", "%Y%m%dT000000", "%Y-%m-%d", "%b %d, %Y", "%Y-%m-%dT00:00:00.000Z"]
    texts = [d.strftime(patterns[k % len(patterns)]) for k, d in enumerate(days)]
    t = encoder(missing_value_generation=None)
    with pytest.warns(UserWarning, match="several forms"):
        made = t.fit_transform(frame(spark, texts), "x", "k")
    assert len(t.forms) == len(patterns)
    assert [x * t.unit() for x in column(made)] == [seconds(d) for d in days]
    assert column(t.reverse_transform(made))[:2] == [d.strftime("%Y-%m-%d 00:00:00") for d in days[:2]]


def test_integers_and_a_given_pattern(spark):
    t = UnixTimestampEncoder(missing_value_generation=None)
    made = t.fit_transform(frame(spark, [1201992, 11022028, 10312001], "int"), "x", "k")
    assert t.datetime_format == "%m%d%Y"
    assert column(t.reverse_transform(made)) == [1201992, 11022028, 10312001]
    t = UnixTimestampEncoder()
    t.fit(frame(spark, [20200105, 20211231], "long"), "x", "k")
    assert t.datetime_format == "%Y%m%d"
    given = UnixTimestampEncoder(datetime_format="%d/%m/%Y", missing_value_generation=None)
    assert column(given.fit_transform(frame(spark, ["01/02/2020"]), "x", "k")) == [seconds(dt.datetime(2020, 2, 1))]
    assert given.texts(given.inputs()) is None
    with pytest.raises(InvalidDataError, match="shape"):
        UnixTimestampEncoder().fit(frame(spark, ["01/02/2020", "soon"]), "x")
    with pytest.raises(InvalidDataError, match="shape"):
        UnixTimestampEncoder().fit(frame(spark, ["13/13/2020"]), "x")
    with pytest.raises(InvalidDataError, match="fit"):
        UnixTimestampEncoder(missing_value_generation=None).fit(frame(spark, ["2020-02-30"]), "x")
    with pytest.raises(InvalidDataError, match="shapes"):
        UnixTimestampEncoder().fit(frame(spark, ["".join(random.Random(i).choices("abcdefgh", k=9)) for i in range(5000)]), "x")
    empty = UnixTimestampEncoder()
    assert column(empty.fit_transform(frame(spark, [None, None]), "x", "k")) == [0.0, 0.0]


def test_columns_share_one_scan_of_shapes(spark):
    """However many columns of strings there are, their shapes are one grouping."""
    from tessella.operators.base import with_key
    from tessella.plans import fusion

    df = with_key(spark.createDataFrame([("05.01.2020", "1/5/2020"), ("06.01.2020", "10/6/2020")], "a string, b string"), None)
    own = {c: UnixTimestampEncoder() for c in "ab"}
    for c, t in own.items():
        t.prepare(df, c)
    asked, whole = [], fusion.date_shapes
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        fusion.date_shapes = lambda df, texts: asked.append(len(texts)) or whole(df, texts)
        try:
            fusion.fit_together(df, list(own.values()))
        finally:
            fusion.date_shapes = whole
    assert asked == [2]
    assert [t.datetime_format for t in own.values()] == ["%d.%m.%Y", "%-m/%-d/%Y"]


@pytest.mark.parametrize("raw", ["9-9-9-9", "room 9 9999", "9999 9999", "Jan Feb 9", "9:99", "99999999 99", "", "x", "99 99", "99999"])
def test_no_dates(raw):
    assert date_shapes.infer([(raw, 1, [5] * 7, [9] * 7)]) == ([], raw)


def test_patterns_are_checked():
    for bad in ("%Q", "%", "%Y-%"):
        with pytest.raises(ValueError, match="pattern|directive"):
            dates.spark_pattern(bad)
    assert dates.spark_pattern("%-d o'clock %% %b'", parsing=True) == "d' o''clock '% MMM''"
