"""Small frames with known results."""

import datetime as dt
import math
from statistics import NormalDist, fmean, pstdev

import duckdb
import pytest
from pyspark.sql import functions as F

from tessella.errors import InvalidDataError, TransformerInputError, TransformerProcessingError
from tessella.functions.permutation import Permutation
from tessella.operators.boolean import BinaryEncoder
from tessella.operators.categorical import FrequencyEncoder, LabelEncoder, OneHotEncoder, OrderedLabelEncoder, OrderedUniformEncoder, UniformEncoder
from tessella.operators.ids import IndexGenerator, RegexGenerator
from tessella.operators.null import NullTransformer
from tessella.operators.numeric import ClusterBasedNormalizer, FloatFormatter, GaussianNormalizer, LogitScaler, LogScaler
from tessella.operators.pii import AnonymizedFaker, PseudoAnonymizedFaker, get_anonymized_transformer
from tessella.operators.temporal import UNITS, OptimizedTimestampEncoder, UnixTimestampEncoder
from tessella.plans.performance import nulls_left
from tessella.sources.providers import number, pick, register


def frame(spark, values, kind):
    return spark.createDataFrame(list(enumerate(values)), f"k int, x {kind}")


def column(df, name="x"):
    return [r[name] for r in df.orderBy("k").collect()]


def test_float_mean(spark):
    t = FloatFormatter()
    assert column(t.fit_transform(frame(spark, [1.0, 2.0, 1.0, 2.0, 1.0, None], "double"), "x", "k"))[5] == pytest.approx(1.4)


def test_nan_is_missing_and_negative_zero_is_zero(spark):
    made = column(FloatFormatter(missing_value_replacement=9.0).fit_transform(frame(spark, [float("nan"), -0.0], "double"), "x", "k"))
    assert made == [9.0, 0.0]
    assert str(made[1]) == "0.0"


@pytest.mark.parametrize(
    ("values", "digits"),
    [([10.0, 0.0, 0.1, 0.12, 0.123], 3), ([1.0, 2.0], 0), ([12345678901234567890.0], 0), ([0.1234567890123456], None), ([None, 0.5], 1), ([None], None), ([float("inf"), 1.5], None)],
)
def test_rounding_digits(spark, values, digits):
    t = FloatFormatter(learn_rounding_scheme=True)
    t.fit(frame(spark, values, "double"), "x")
    assert t.digits == digits


def test_integers_with_nulls_come_back(spark):
    for kind in ("tinyint", "smallint", "int", "bigint"):
        t, df = FloatFormatter(missing_value_generation="from_column"), frame(spark, [1, 2, 3, None], kind)
        back = t.reverse_transform(t.fit_transform(df, "x", "k"))
        assert column(back) == [1, 2, 3, None]
        assert dict(back.dtypes)["x"] == kind


def test_representation_is_checked(spark):
    with pytest.raises(ValueError, match="can't hold"):
        FloatFormatter(computer_representation="UInt8").fit(frame(spark, [-1.0, 2.0], "double"), "x")
    with pytest.raises(ValueError, match="fractions"):
        FloatFormatter(computer_representation="Int8").fit(frame(spark, [1.5], "double"), "x")


def test_null_share_and_parameters(spark):
    t = NullTransformer("mean", "random")
    with pytest.raises(ValueError):
        t._set_fitted_parameters(1.5)
    with pytest.raises(TransformerInputError):
        NullTransformer(None, "sometimes")
    df = frame(spark, [None, None], "double")
    for how in ("mean", "mode", "random"):
        assert column(FloatFormatter(how).fit_transform(df, "x", "k")) == [0.0, 0.0]


def test_operators_fitted_without_data(spark):
    t = FloatFormatter(missing_value_replacement=None, enforce_min_max_values=True)
    nulls = NullTransformer(0.0, "random")
    nulls._set_fitted_parameters(0.0)
    nulls.value = 0.0
    t._set_fitted_parameters("x", nulls, rounding_digits=None, min_max_values=(0.0, 2.0))
    assert column(t.transform(frame(spark, [None, 1.0], "double"))) == [0.0, 1.0]
    assert column(t.reverse_transform(frame(spark, [5.0, -1.0], "double"))) == [2.0, 0.0]
    t = UniformEncoder()
    t._set_fitted_parameters("x", {"a": (0.0, 0.25), "b": (0.25, 1.0)})
    assert column(t.reverse_transform(frame(spark, [0.1, 0.9], "double"))) == ["a", "b"]
    t = AnonymizedFaker("person", "name", cardinality_rule="match")
    with pytest.raises(TransformerInputError):
        t._set_fitted_parameters("x")
    t._set_fitted_parameters("x", cardinality=2)
    assert len(set(column(t.reverse_transform(spark.range(6).selectExpr("id AS k"))))) == 2


def test_scalers_refuse_what_they_cannot_map(spark):
    with pytest.raises(InvalidDataError):
        LogScaler(constant=1.0).fit(frame(spark, [1.0, 2.0], "double"), "x")
    with pytest.raises(InvalidDataError):
        LogitScaler().fit(frame(spark, [0.5, 1.5], "double"), "x")
    with pytest.raises(TransformerInputError):
        LogitScaler(min_value=2.0, max_value=1.0)


@pytest.mark.parametrize("t", [LogScaler(), LogScaler(constant=9.0, invert=True), LogitScaler(min_value=0.0, max_value=10.0)])
def test_scalers_round_trip(spark, t):
    values = [0.5, 1.0, 2.5, 7.0]
    assert column(t.reverse_transform(t.fit_transform(frame(spark, values, "double"), "x", "k"))) == pytest.approx(values)


@pytest.mark.parametrize("family", ["norm", "uniform", "truncnorm", "gamma", "beta", "t", "gaussian_kde"])
def test_gaussian_round_trip(spark, family):
    df = frame(spark, [4 + 4 * ((i * 7919 % 1000) / 1000 + (i * 104729 % 1009) / 1009 + (i * 1299709 % 997) / 997 - 1.5) * 2 for i in range(1000)], "double")
    t = GaussianNormalizer(distribution=family)
    made = t.fit_transform(df, "x", "k")
    z = column(made)
    assert abs(sum(z) / len(z)) < 0.15
    errors = sorted(abs(a - b) for a, b in zip(column(t.reverse_transform(made)), column(df), strict=True))
    assert errors[949] < 0.1
    assert t.learned_distribution["distribution"] == family


def test_the_kernel_density_is_that_of_all_values(spark):
    values = [math.exp(2 * NormalDist().inv_cdf((i * 7919 % 4001 + 0.5) / 4001)) for i in range(4001)]
    t = GaussianNormalizer(distribution="gaussian_kde")
    asked = [sorted(values)[int(4001 * q)] for q in (0.001, 0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 0.999)]
    t.fit(frame(spark, [*values, None], "double"), "x")
    band = 1.06 * pstdev(values) * 4001**-0.2
    expected = [fmean(NormalDist(v, band).cdf(x) for v in values) for x in asked]
    assert [NormalDist().cdf(z) for z in column(t.transform(frame(spark, asked, "double")))] == pytest.approx(expected, abs=5e-5)


def test_clusters_are_found(spark):
    values = [5 + (i * 37 % 100 - 50) / 1000 for i in range(300)] + [-4 + (i * 37 % 100 - 50) / 500 for i in range(1000)] + [100 + (i * 37 % 100 - 50) / 10 for i in range(500)]
    t, df = ClusterBasedNormalizer(), frame(spark, values, "double")
    made = t.fit_transform(df, "x", "k")
    assert {round(m) for m in t.mixture.means} >= {5, -4, 100}
    errors = sorted(abs(a - b) for a, b in zip(column(t.reverse_transform(made)), values, strict=True))
    assert errors[int(len(errors) * 0.95)] < 0.1


def test_binary(spark):
    t = BinaryEncoder(missing_value_replacement=None, missing_value_generation="from_column")
    made = t.fit_transform(frame(spark, [True, None, False], "boolean"), "x", "k")
    assert column(made, "x.is_null") == [0.0, 1.0, 0.0]
    assert column(t.reverse_transform(made)) == [True, None, False]


@pytest.mark.parametrize("how", ["new_category", None])
@pytest.mark.parametrize("encoder", [UniformEncoder, LabelEncoder])
def test_missing_categories(spark, encoder, how):
    values = ["a", None, "b", "a", None]
    t = encoder(missing_value_encoding=how)
    made = t.fit_transform(frame(spark, values, "string"), "x", "k")
    assert (column(made)[1] is None) == (how is None)
    assert column(t.reverse_transform(made)) == values


def test_uniform_values_lie_in_their_intervals_and_are_clipped(spark):
    t = UniformEncoder()
    made = column(t.fit_transform(frame(spark, [1, 2, 3, 2, 1, 1, 1], "int"), "x", "k"))
    for v, x in zip([1, 2, 3, 2, 1, 1, 1], made, strict=True):
        low, high = t.intervals[v]
        assert low <= x <= high
    assert t.intervals[1] == [0.0, 4 / 7]
    assert column(t.reverse_transform(frame(spark, [-0.1, 100.0, 0.5], "double"))) == [1, 3, 1]


@pytest.mark.parametrize("kind", ["string", "int"])
def test_ordered_encoders_of_many_categories(spark, kind):
    order = [None if i == 700 else str((i * 7919) % 1501) for i in range(1501)]
    values = [v if kind == "string" else v and int(v) for v in order if v not in ("3", "1200")]
    df = frame(spark, values, kind)
    t = OrderedLabelEncoder(order)
    made = t.fit_transform(df, "x", "k")
    assert column(made) == [order.index(None if v is None else str(v)) for v in values]
    assert column(t.reverse_transform(made)) == values
    t = OrderedUniformEncoder(order)
    made = t.fit_transform(df, "x", "k")
    share = [0.1 / 2 if v in ("3", "1200") else 0.9 / len(values) for v in order]
    for v, x in zip(values, column(made), strict=True):
        at = order.index(None if v is None else str(v))
        assert sum(share[:at]) - 1e-9 <= x <= sum(share[: at + 1]) + 1e-9
    assert column(t.reverse_transform(made)) == values
    for short in (order[:-1], order[1:]):
        with pytest.raises(TransformerInputError, match="order lacks"):
            OrderedLabelEncoder(short).fit(df, "x")


def test_ordered_encoders(spark):
    df = frame(spark, ["tepid", "boiling", None, "7"], "string")
    assert column(OrderedLabelEncoder([7, "tepid", None, "boiling"]).fit_transform(df, "x", "k")) == [1, 3, 2, 0]
    with pytest.raises(TransformerInputError, match="lacks"):
        OrderedUniformEncoder(["tepid"]).fit(df, "x")
    with pytest.raises(TransformerInputError, match="repeated"):
        OrderedLabelEncoder(["a", "a"])


@pytest.mark.filterwarnings("ignore:FrequencyEncoder")
def test_frequency(spark):
    t = FrequencyEncoder()
    made = t.fit_transform(frame(spark, ["a", "b", "a", "c"], "string"), "x", "k")
    assert column(made) == [0.25, 0.625, 0.25, 0.875]
    assert column(t.reverse_transform(made)) == ["a", "b", "a", "c"]


def test_one_hot(spark):
    t = OneHotEncoder()
    values = ["oak", "elm", "elm", "fir"]
    made = t.fit_transform(frame(spark, values, "string"), "x", "k")
    assert [column(made, f"x.value{i}") for i in range(3)] == [[1, 0, 0, 0], [0, 1, 1, 0], [0, 0, 0, 1]]
    assert column(t.reverse_transform(made)) == values
    with pytest.raises(TransformerInputError, match="most_columns"):
        OneHotEncoder(most_columns=2).fit(frame(spark, values, "string"), "x")


def test_one_hot_of_many_categories(spark):
    df = spark.range(1100).selectExpr("id AS k", "'c' || id AS x")
    t = OneHotEncoder(most_columns=2000)
    t.fit(df, "x", "k")
    assert len(t.dummies) == 1100


def test_unseen_categories(spark):
    t = LabelEncoder()
    t.fit(frame(spark, ["a", "b"], "string"), "x", "k")
    df = frame(spark, ["a", "z"], "string")
    assert column(t.transform(df))[1] in (0, 1)
    assert t.unseen_values(df) == ["z"]
    with pytest.warns(UserWarning, match="not seen"):
        t.transform(df, validate=True)


def test_mappings_of_many_categories_are_tables(spark):
    df = spark.range(1500).selectExpr("id AS k", "'c' || id AS x")
    t = LabelEncoder()
    made = t.fit_transform(df, "x", "k")
    with pytest.raises(TransformerInputError, match="mapping_table"):
        _ = t.categories_to_values
    assert t.mapping_table(df).count() == 1500
    assert column(t.reverse_transform(made)) == [f"c{i}" for i in range(1500)]


def test_dictionaries_of_some_hundred_rows_are_broadcast(spark):
    df = spark.range(3000).selectExpr("id AS k", "'c' || (id % 300) AS x")
    t = LabelEncoder(order_by="alphabetical")
    made = t.fit_transform(df, "x", "k")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    assert "SortMergeJoin" not in plan
    order = sorted(f"c{i}" for i in range(300))
    assert column(made) == [order.index(f"c{i % 300}") for i in range(3000)]


def test_negative_keys_come_before_positive_ones(spark):
    df = spark.createDataFrame([(-5, "a"), (3, "b"), (-40, "c"), (20, "d")], "k long, x string")
    t = LabelEncoder()
    t.fit(df, "x", "k")
    assert list(t.categories_to_values) == ["c", "a", "b", "d"]


DATES = [None, dt.datetime(2003, 6, 2), dt.datetime(1958, 2, 27)]
DAYS = [None, *((d - dt.datetime(1970, 1, 1)).days for d in DATES[1:])]
MEAN_DAY = (DAYS[1] + DAYS[2]) / 2


def test_unix_timestamps(spark):
    t = UnixTimestampEncoder(missing_value_generation="from_column")
    made = t.fit_transform(frame(spark, DATES, "timestamp_ntz"), "x", "k")
    assert column(made) == [x * 86400e9 for x in (MEAN_DAY, *DAYS[1:])]
    assert column(made, "x.is_null") == [1.0, 0.0, 0.0]
    assert column(t.reverse_transform(made)) == DATES


def test_date_strings_and_numbers(spark):
    t = UnixTimestampEncoder(datetime_format="%b %d, %Y", missing_value_generation=None)
    texts = [d and d.strftime("%b %d, %Y") for d in DATES]
    made = t.fit_transform(frame(spark, texts, "string"), "x", "k")
    assert column(made) == [x * 86400e9 for x in (MEAN_DAY, *DAYS[1:])]
    middle = dt.datetime(1970, 1, 1) + dt.timedelta(days=MEAN_DAY)
    assert column(t.reverse_transform(made)) == [middle.strftime("%b %d, %Y"), *texts[1:]]
    t = UnixTimestampEncoder(datetime_format="%m%d%Y")
    numbers = [3152004, 12311999, 7041976]
    made = t.fit_transform(frame(spark, numbers, "int"), "x", "k")
    assert column(made)[0] == (dt.datetime(2004, 3, 15) - dt.datetime(1970, 1, 1)).days * 86400e9
    assert column(t.reverse_transform(made)) == numbers
    with pytest.raises(InvalidDataError):
        UnixTimestampEncoder(datetime_format="%Y").fit(frame(spark, ["x"], "string"), "x")


def test_time_zones(spark):
    t, values = UnixTimestampEncoder(datetime_format="%Y-%m-%d %H:%M:%S%z"), ["2019-07-01 21:15:09+0530", "2019-12-24 00:30:00+0530"]
    assert column(t.reverse_transform(t.fit_transform(frame(spark, values, "string"), "x", "k"))) == values
    t, values = UnixTimestampEncoder(datetime_format="%Y-%m-%d %H:%M:%S%z"), ["2019-07-01 21:15:09+0530", "2019-12-24 00:30:00-0800"]
    with pytest.warns(UserWarning, match="time zones"):
        made = t.fit_transform(frame(spark, values, "string"), "x", "k")
    assert column(t.reverse_transform(made)) == ["2019-07-01 15:45:09+0000", "2019-12-24 08:30:00+0000"]


def test_optimized_timestamps(spark):
    t = OptimizedTimestampEncoder(missing_value_generation="from_column")
    made = t.fit_transform(frame(spark, DATES, "timestamp_ntz"), "x", "k")
    assert column(made) == [float(MEAN_DAY // 1), *map(float, DAYS[1:])]
    assert column(t.reverse_transform(made)) == DATES
    kept = OptimizedTimestampEncoder(missing_value_replacement=None, missing_value_generation=None)
    made = kept.fit_transform(frame(spark, DATES, "timestamp_ntz"), "x", "k")
    assert column(made) == [None, *map(float, DAYS[1:])]
    assert nulls_left(made, kept) == {"x": 1}


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Kolkata"])
def test_times_do_not_depend_on_the_zone_of_the_session(spark, zone):
    """Also a time that the zone's clocks skip, and midnights."""
    values = [dt.datetime(2021, 3, 14, 2, 30), dt.datetime(1996, 1, 5), dt.datetime(2030, 11, 3, 1, 15, 7)]
    texts = [v.strftime("%d/%m/%Y %I:%M:%S %p") for v in values]
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        t = UnixTimestampEncoder()
        made = t.fit_transform(frame(spark, values, "timestamp_ntz"), "x", "k")
        assert column(made) == [(v - dt.datetime(1970, 1, 1)).total_seconds() * 1e9 for v in values]
        assert column(t.reverse_transform(made)) == values
        t = UnixTimestampEncoder(datetime_format="%d/%m/%Y %I:%M:%S %p")
        assert column(t.fit_transform(frame(spark, texts, "string"), "x", "k")) == column(made)
        assert column(t.reverse_transform(made)) == texts
        t = OptimizedTimestampEncoder()
        made = t.fit_transform(frame(spark, [v.date() for v in values], "date"), "x", "k")
        assert t.divider == 86400 * 10**9
        assert column(t.reverse_transform(made)) == [v.date() for v in values]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_index_goes_on_and_starts_over(spark):
    t = IndexGenerator("p_", 5, "_s")
    df = frame(spark, ["a", "b"], "string")
    made = t.fit_transform(df, "x", "k")
    assert made.columns == ["k"]
    assert column(t.reverse_transform(made)) == ["p_5_s", "p_6_s"]
    assert column(t.reverse_transform(made)) == ["p_7_s", "p_8_s"]
    t.reset_randomization()
    assert column(t.reverse_transform(made)) == ["p_5_s", "p_6_s"]


def test_regex_rules(spark):
    df = frame(spark, ["v"] * 5, "string")
    assert column(_made(RegexGenerator("[a-b]"), df)) == ["a", "b", "a", "b", "a"]
    assert column(_made(RegexGenerator("[0-2]", cardinality_rule="unique"), df)) == ["0", "1", "2", "3", "4"]
    scrambled = column(_made(RegexGenerator("[a-z]", generation_order="scrambled"), df))
    assert len(set(scrambled)) == 5
    assert scrambled != ["a", "b", "c", "d", "e"]
    repeated = frame(spark, [f"v{i // 50}" for i in range(200)], "string")
    made = column(_made(RegexGenerator("[A-Z]", cardinality_rule="scale"), repeated))
    assert made == [c for c in "ABCD" for _ in range(50)]


def _made(t, df):
    return t.reverse_transform(t.fit_transform(df, "x", "k"))


def test_scale_follows_the_histogram(spark):
    values = ["A"] * 50 + ["B"] * 100
    made = column(_made(RegexGenerator("[A-Z]{3}", cardinality_rule="scale"), frame(spark, values * 3, "string")))
    counts = {v: made.count(v) for v in set(made)}
    assert len(made) == 450
    assert all(n in (150, 300) or v == max(counts) for v, n in counts.items())


def test_scale_goes_on_over_calls(spark):
    """Calls of any sizes give what one call gives."""
    data = spark.range(60).selectExpr("id AS k", "CAST(sqrt(id) AS BIGINT) AS x")
    rows = lambda n: spark.range(n).selectExpr("id AS k")
    for make in (lambda: RegexGenerator("[A-Z]{3}", cardinality_rule="scale"), lambda: AnonymizedFaker("person", "name", cardinality_rule="scale")):
        whole, parts = make(), make()
        for t in (whole, parts):
            t.fit(data, "x", "k")
        expected = column(whole.reverse_transform(rows(100)))
        got = [x for n in (1, 30, 0, 7, 62) for x in column(parts.reverse_transform(rows(n)))]
        assert got == expected
        parts.reset_randomization()
        assert column(parts.reverse_transform(rows(40))) == expected[:40]


def test_scale_of_many_counts_joins_the_histogram(spark):
    data = spark.range(200).selectExpr("explode(sequence(1, CAST(id + 1 AS INT))) AS n", "id AS x").selectExpr("monotonically_increasing_id() AS k", "x")
    t = RegexGenerator("[A-Z]{4}", cardinality_rule="scale")
    t.fit(data, "x", "k")
    assert len(t.repetitions) == 200
    made = t.reverse_transform(spark.range(5000).selectExpr("id AS k"))
    counts = [r["count"] for r in made.groupBy("x").count().collect()]
    assert sum(counts) == 5000
    assert max(counts) <= 200


def test_rows_without_keys_are_numbered_without_a_shuffle(spark):
    t = IndexGenerator("r")
    t.fit(spark.createDataFrame([("a",)], "x string"), "x")
    made = t.reverse_transform(spark.range(0, 1000, 1, 7).where("id % 3 <> 0"))
    assert sorted(int(r.x[1:]) for r in made.collect()) == list(range(666))
    plan = made.select("id", "x")._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" not in plan


def test_arguments_of_providers(spark):
    def made(function, **kwargs):
        t = AnonymizedFaker("BaseProvider", function, kwargs)
        t._set_fitted_parameters("x")
        return column(t.reverse_transform(spark.range(200).selectExpr("id AS k")))

    assert set("".join(made("lexify", text="????", letters="XY"))) == {"X", "Y"}
    assert {int(v) for v in made("random_int", min=10, max=20, step=5)} == {10, 15, 20}
    assert all(v[0].isdigit() and v[1] in "QR" for v in made("bothify", text="#?", letters="QR"))


def test_fakes(spark):
    df = frame(spark, [None if i % 4 == 0 else f"v{i % 10}" for i in range(100)], "string")
    made = column(_made(AnonymizedFaker("internet", "email"), df))
    assert sum(v is None for v in made) == 25
    assert all("@" in v for v in made if v)
    match = column(_made(AnonymizedFaker("person", "first_name", cardinality_rule="match", missing_value_generation=None), df))
    assert len(set(match)) == len({v for v in column(df) if v})
    with pytest.raises(TransformerProcessingError):
        AnonymizedFaker("person", "nothing")
    assert get_anonymized_transformer("email").function_name == "email"


def test_pseudonyms(spark):
    t, df = PseudoAnonymizedFaker("person", "name"), frame(spark, ["a", "b", "a", None], "string")
    made = column(t.fit_transform(df, "x", "k"))
    assert made[0] == made[2] != made[1]
    assert made[3] is None
    assert set(t.get_mapping()) == {"a", "b"}
    with pytest.raises(Exception, match="not seen"):
        t.transform(frame(spark, ["new"], "string")).collect()


def test_scrambled_goes_through_all_strings(spark):
    rows = spark.range(676).selectExpr("id AS k")
    made = {}
    for name in ("x", "y"):
        t = RegexGenerator("[A-Z]{2}", generation_order="scrambled", cardinality_rule="unique")
        t.fit(spark.createDataFrame([(0, "a")], f"k long, {name} string"), name, "k")
        made[name] = [column(t.reverse_transform(rows.limit(n)), name) for n in (300, 376)]
        assert len(set(made[name][0] + made[name][1])) == 676
        number = [26 * (ord(s[0]) - 65) + ord(s[1]) - 65 for s in made[name][0]]
        assert len({(b - a) % 676 for a, b in zip(number, number[1:])}) > 100
    assert sum(a == b for a, b in zip(made["x"][0], made["y"][0])) < 10
    large = RegexGenerator("[A-Z0-9]{20}", generation_order="scrambled")
    large.fit(spark.createDataFrame([(0, "a")], "k long, x string"), "x", "k")
    assert len(set(column(large.reverse_transform(rows)))) == 676


def test_unique_values_over_calls_and_beyond_the_values(spark):
    rows = spark.range(400).selectExpr("id AS k")
    t = AnonymizedFaker("person", "name", cardinality_rule="unique")
    t._set_fitted_parameters("x")
    first = column(t.reverse_transform(rows))
    assert len(set(first)) == 400
    assert all(" " in v for v in first)
    with pytest.warns(UserWarning, match="more than the 625"):
        second = column(t.reverse_transform(rows))
    assert len({*first, *second}) == 800
    assert sum(" " in v for v in second) == 225
    assert all(len(v) == 6 and v.islower() for v in second if " " not in v)
    plan = t.reverse_transform(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # a row for each range of row numbers
    for provider, function, kwargs in [("internet", "ipv6", {}), ("BaseProvider", "random_element", {"elements": ["a", "b", "a", "c"]}), ("BaseProvider", "lexify", {"text": "??", "letters": "xy"})]:
        t = AnonymizedFaker(provider, function, kwargs, cardinality_rule="unique")
        t._set_fitted_parameters("x")
        assert len(set(column(t.reverse_transform(rows)))) == 400


def test_a_provider_of_ones_own(spark):
    register("shop", "sku", lambda draw: F.concat(pick(draw("kind"), ["A", "B"]), F.lit("-"), number(draw("n"), 2)))
    register("shop", "raw", lambda draw: F.round(draw("u"), 3).cast("string"))
    t = AnonymizedFaker("shop", "sku", cardinality_rule="unique")
    t._set_fitted_parameters("x")
    made = column(t.reverse_transform(spark.range(200).selectExpr("id AS k")))
    assert sorted(made) == sorted(f"{kind}-{n:02d}" for kind in "AB" for n in range(100))
    raw = AnonymizedFaker("shop", "raw")
    raw._set_fitted_parameters("x")
    assert column(raw.reverse_transform(spark.range(3).selectExpr("id AS k")))[0].startswith("0.")
    raw = AnonymizedFaker("shop", "raw", cardinality_rule="unique")
    raw._set_fitted_parameters("x")
    with pytest.raises(TransformerProcessingError, match="told apart"):
        raw.reverse_transform(spark.range(3).selectExpr("id AS k"))


@pytest.mark.parametrize("size", [1, 2, 7, 1000, 1001, 1009, 26**4, 1_000_003, 10**12 + 39, (1 << 62) + 5, (1 << 63) - 1])
def test_permutations(spark, size):
    p = Permutation(size, "k|1")
    some = sorted({i for i in [*range(30), size // 2, *range(size - 30, size)] if 0 <= i < size}) if size > 2000 else list(range(size))
    expected = [p.number(i) for i in some]
    assert len(set(expected)) == len(some)
    assert all(0 <= x < size for x in expected)
    assert size > 2000 or sorted(expected) == some
    df, made = p.column(spark.createDataFrame([(i,) for i in some], "i long"), F.col("i"))
    assert [r.x for r in df.select("i", made.alias("x")).orderBy("i").collect()] == expected
    assert duckdb.sql(f"SELECT p FROM {p.sql('i', '(SELECT unnest(' + str(some) + ') AS i)', 'p')} ORDER BY i").fetchall() == [(x,) for x in expected]
    assert size < 100 or [Permutation(size, "k|2").number(i) for i in some] != expected
    if 10**6 < size < 10**7:
        assert len({p.number(i) for i in range(size)}) == size


def test_pattern_is_inferred_before_the_statistics(spark):
    dates = frame(spark, ["03/04/2011", None, "25/12/2013"], "string")
    for kind in (UnixTimestampEncoder, OptimizedTimestampEncoder):
        t = kind(missing_value_generation=None)
        t.fit(dates, "x", "k")
        assert t.datetime_format == "%d/%m/%Y"  # the other order has no month 25
        # one pattern's statistics
        assert len(t.requests(t.inputs(), t.kinds)) < 2 * len(UNITS)
        day = (dt.date(2013, 12, 25) - dt.date(1970, 1, 1)).days
        assert column(t.transform(dates))[2] * t.unit() == day * 86400e9
        assert column(t.reverse_transform(t.transform(dates)))[2] == "25/12/2013"
    with pytest.raises(InvalidDataError, match="no known pattern"):
        UnixTimestampEncoder().fit(frame(spark, ["no date"], "string"), "x")
