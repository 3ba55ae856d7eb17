"""op5 lets its texts' shuffle files go before the bands' are written."""

from corpuslab.llm._shared import release


def test_shuffles_of_frames_in_a_cycle_are_released(spark):
    known = spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses()
    release(spark)
    before = known.size()
    held = [spark.range(1000).repartition(3, "id")]
    held.append(held)
    assert len(held[0].collect()) == 1000 and known.size() > before
    del held
    release(spark)
    assert known.size() <= before
