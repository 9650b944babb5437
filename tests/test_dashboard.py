"""Findings of the dashboard whose order matters."""

from tidemark.operators import dashboard


def test_ties_of_affinities_go_by_the_subject(spark):
    rows = [("Brand#1", "x", 6.0, 10), ("Brand#16", "x", 6.0, 10), ("Brand#2", "x", 5.0, 10)]
    found = spark.createDataFrame(rows, "cluster string, label string, lift double, n long")
    assert [tuple(r) for r in dashboard.top_major_affinity(found, "cluster", "label", size="n").collect()] == [("Brand#16:x", 6.0)]
