"""Queries whose results hang on how numbers are rounded."""

from aerolattice.plans import more_queries


def test_equal_means_go_to_the_first_model(spark):
    """Both crops' values are the same, in another order, so that the sums' last digits differ."""
    rows = [(1, 1, c) for c in (0.3, 0.2, 0.1)] + [(1, 2, c) for c in (0.1, 0.2, 0.3)]
    df = spark.createDataFrame(rows, "frame long, crop long, conf double").coalesce(1)
    assert more_queries.best_models(df).collect() == [(1, 1, 3)]


def test_splits_of_ninety_sequences(spark):
    """Seven in ten of 90 are 63, though 0.7 * 90 is less as a float."""
    counts = more_queries.default_splits(spark.range(90).withColumnRenamed("id", "seq")).groupBy("split").count()
    assert dict(map(tuple, counts.collect())) == {"train": 63, "val": 13, "test": 14}
