"""Profiles on values that floating point cannot say exactly."""

from kinmatch.operators import profile


def test_mining_margin_is_rounded(spark):
    rows = spark.createDataFrame([(0.6, True), (0.4, False), (0.55, True)], "score double, label boolean")
    assert {tuple(x) for x in profile.mining_readiness(rows, 0.5).collect()} == {(1, 1, 1), (0, 1, 0)}
