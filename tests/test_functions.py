import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import codec, compositional, infotheory, special, vectors


def value(spark, c, **cols):
    row = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} array<double>" for k in cols))
    return row.select(c).first()[0]


def test_vectors(spark):
    a, b = F.col("a"), F.col("b")
    v = dict(a=[1.0, 2.0, 2.0], b=[2.0, 1.0, 2.0])
    assert value(spark, vectors.cosine(a, b), **v) == pytest.approx(0.888889, abs=1e-6)
    assert value(spark, vectors.euclidean(a, b), **v) == pytest.approx(1.414214, abs=1e-6)
    assert value(spark, vectors.gauss_kernel(a, b, 1), **v) == pytest.approx(0.135335, abs=1e-6)
    assert value(spark, vectors.gauss_kernel(a, b, 2), **v) == pytest.approx(0.606531, abs=1e-6)
    assert value(spark, vectors.vmf_kernel(a, b, 2), **v) == pytest.approx(5.916694, abs=1e-6)
    assert value(spark, vectors.unit(a), a=[0.0, 0.0]) == [0, 0] and value(spark, vectors.cosine(a, b), a=[0.0], b=[1.0]) == 0


def test_compositions(spark):
    p = F.col("p")
    assert value(spark, compositional.clr(p), p=[0.2, 0.3, 0.5]) == pytest.approx([-0.440585, -0.035120, 0.475705], abs=1e-6)
    assert value(spark, compositional.softmax(compositional.clr(p)), p=[0.6, 0.3, 0.1]) == pytest.approx([0.6, 0.3, 0.1])
    df = spark.createDataFrame([([0.2, 0.3, 0.5], 1), ([0.6, 0.3, 0.1], 3)], "p array<double>, w int")
    mean = lambda w: [r.center for r in compositional.center(df, "p", w).orderBy("k").collect()]
    assert mean(None) == pytest.approx([0.398165, 0.344821, 0.257014], abs=1e-6) and mean("w") == pytest.approx([0.503516, 0.331332, 0.165152], abs=1e-6)


def test_information(spark):
    d = spark.createDataFrame([(0.5, 0.25), (0.5, 0.5), (0.0, 0.25)], "p double, q double")
    assert infotheory.kl(d, "p", "q").first().kl == pytest.approx(0.5)
    assert infotheory.entropy(spark.createDataFrame([(0.5,), (0.25,), (0.25,)], "p double"), "p").first().h == pytest.approx(1.5)
    c = spark.createDataFrame([(0.5, 0.9), (0.5, 0.1)], "p double, q double")
    assert infotheory.entropy(c, "p", q="q").first().h == pytest.approx(1.736966, abs=1e-6)
    z = spark.createDataFrame([(0.5, 0.0), (0.5, 1.0)], "p double, q double")
    assert infotheory.kl(z, "p", "q").first().kl == float("inf")
    pairs = spark.createDataFrame(list(zip("aabbb", "xxxyy")), "a string, b string")
    r, s = infotheory.mutual_information(pairs, "a", "b").first(), infotheory.mutual_information(pairs, "a", "b", 1.0).first()
    assert (r.mi, r.nmi, s.mi, s.nmi) == pytest.approx((0.419973, 0.432538, 0.091091, 0.091911), abs=1e-6)
    same = spark.createDataFrame([(x, x) for x in "abca"], "a string, b string")
    assert infotheory.mutual_information(same, "a", "b").first().nmi == pytest.approx(1)


def test_feature_selection(spark):
    t = spark.createDataFrame([(c, f, n) for c, row in enumerate([[30.0, 10.0], [20.0, 40.0]]) for f, n in enumerate(row)], "cls int, feature int, cnt double")
    assert infotheory.information_gain(t).first().ig == pytest.approx(0.086305, abs=1e-6)
    r = infotheory.chi_squared(t).first()
    assert r.chi2 == pytest.approx(16.666667, abs=1e-6) and r.dof == 1 and r.p_value == pytest.approx(4.455709e-05, rel=1e-5)


def test_tails():
    assert special.chi2_p(3.841458821, 1) == pytest.approx(0.05, abs=1e-8) and special.chi2_p(0, 3) == 1 and special.chi2_p(18.307038, 10) == pytest.approx(0.05, abs=1e-7)
    assert special.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-8) and special.t_two_sided(0, 5) == pytest.approx(1) and special.t_two_sided(12.7062, 1) == pytest.approx(0.05, abs=1e-5)


def test_codec():
    assert np.frombuffer(codec.compress(np.array([0, 1, 126, 127, 300, 16129])), np.int8).tolist() == [-1, -2, -127, -1, 1, -47, 2, -1, 0, 1]
    with pytest.raises(ValueError):
        codec.compress(np.array([-1]))


@given(st.lists(st.integers(0, 2**50)))
def test_codec_round_trip(xs):
    assert codec.decompress(codec.compress(np.array(xs, np.int64))).tolist() == xs
