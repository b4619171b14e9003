"""Exact sums against math.fsum."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestep.functions import exact


@settings(max_examples=300, deadline=None)
@given(st.lists(st.floats(-1e300, 1e300), min_size=1))
def test_limbs_of_arrays(values):
    assert exact.rounded(list(exact.limbs_of(np.array(values)).items())) == math.fsum(values)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    wide = [rng.choice([-1, 1]) * rng.random() * 2.0 ** rng.randrange(-1074, 1020) for _ in range(400)]
    near = [rng.gauss(0, 1) * 10.0 ** rng.randrange(-6, 7) for _ in range(1500)]
    edges = [5e-324, -5e-324, 2.0**-1022, 2.0**1023, -(2.0**1023), 1e16, 1.0, -1e16, 2.0**53, 2.0**53 + 2, 2.0**-900, 0.1, 0.0, -0.0]
    out = [("wide", x) for x in wide] + [("near", x) for x in near] + [("edges", x) for x in edges] + [("thirds", 1 / 3)] * 777 + [("ties", x) for x in (2.0**53, 1.0, 2.0**53, -(2.0**53))]
    return out + [("zeros", 0.0), ("nulls", None), ("some", None), ("some", 2.5), ("inf", math.inf), ("inf", 1.0), ("nan", math.inf), ("nan", -math.inf), ("less", -math.inf)]


def test_columns_equal_fsum_in_any_partitioning(spark, rows):
    want = {g: math.fsum(x for h, x in rows if h == g and x is not None) for g in ("wide", "near", "edges", "thirds", "ties", "zeros", "some")} | {"inf": math.inf, "less": -math.inf}
    df = spark.createDataFrame(rows, "g string, x double")
    for cut in (df.coalesce(1), df.repartition(7), df.repartition(3, "x").orderBy(F.desc("x"))):
        got = {r.g: r.x for r in exact.exact_sums(cut, ["g"], {"x": F.col("x")}).collect()}
        assert "nulls" not in got and math.isnan(got.pop("nan")) and got == want


def test_several_sums_and_merging(spark):
    df = spark.createDataFrame([(i % 3, i / 7, -i / 11) for i in range(300)], "g int, x double, y double")
    got = {r.g: (r.x, r.y, r.p) for r in exact.exact_sums(df, ["g"], {"x": F.col("x"), "y": F.col("y"), "p": F.col("x") * F.col("y")}).collect()}
    for g in range(3):
        own = [(i / 7, -i / 11) for i in range(300) if i % 3 == g]
        assert got[g] == (math.fsum(x for x, _ in own), math.fsum(y for _, y in own), math.fsum(x * y for x, y in own))
