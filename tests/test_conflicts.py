from test_whole_jobs import detected

from sigweave.operators.detection import Settings


def test_result_that_lost_a_conflict_is_scanned_again(spark):
    """Both items match class 1 at first; what is left of b is found when a has taken it."""
    found = detected(spark, [("a", "x", "x", 20), ("b", "x", "x", 20), ("b", "y", "y", 50)], [("app", "1", "x", 20), ("app", "2", "y", 50)], Settings())
    assert found == [("a", ["1"]), ("b", ["2"])]
