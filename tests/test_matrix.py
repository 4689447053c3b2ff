"""Every operator over every random column of its sdtype, with nulls."""

import pytest
from pyspark.sql import types as T

from tessella.operators.boolean import BinaryEncoder
from tessella.operators.categorical import FrequencyEncoder, LabelEncoder, OneHotEncoder, UniformEncoder
from tessella.operators.ids import IndexGenerator, RegexGenerator
from tessella.operators.numeric import ClusterBasedNormalizer, FloatFormatter, GaussianNormalizer
from tessella.operators.pii import AnonymizedFaker, PseudoAnonymizedFaker
from tessella.operators.temporal import OptimizedTimestampEncoder, UnixTimestampEncoder
from tessella.sources.demo import GENERATORS, random_column

OPERATORS = {
    "numerical": [FloatFormatter, GaussianNormalizer, ClusterBasedNormalizer],
    "categorical": [UniformEncoder, LabelEncoder, OneHotEncoder, FrequencyEncoder],
    "boolean": [BinaryEncoder, UniformEncoder],
    "datetime": [UnixTimestampEncoder, OptimizedTimestampEncoder],
    "id": [IndexGenerator, RegexGenerator],
    "text": [RegexGenerator],
    "pii": [AnonymizedFaker, PseudoAnonymizedFaker],
}


@pytest.mark.filterwarnings("ignore:FrequencyEncoder")
@pytest.mark.parametrize(("sdtype", "operator", "name"), [(s, o, n) for s, os in OPERATORS.items() for o in os for n in GENERATORS[s]])
def test_operator_over_column(spark, sdtype, operator, name):
    data = random_column(spark, sdtype, name, 120, nulls=True)
    t = operator()
    made = t.fit_transform(data, "value", "row")
    assert made.columns == ["row", *t.get_output_columns()]
    rows = made.collect()
    assert len(rows) == 120
    if not isinstance(t, PseudoAnonymizedFaker):
        assert all(isinstance(f.dataType, T.NumericType) for f in made.schema.fields)
        assert all(v is not None for r in rows for v in r)
    back = t.reverse_transform(made)
    assert sorted(back.columns) == ["row", "value"]
    assert back.count() == 120
    if sdtype in ("categorical", "boolean") and not isinstance(t, BinaryEncoder):
        assert sorted(map(repr, back.select("row", "value").collect())) == sorted(map(repr, data.select("row", "value").collect()))
