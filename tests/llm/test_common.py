import pytest

from pagelattice.llm import common

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_small_batches_leave_the_setting_as_it_was(spark):
    before = spark.conf.get(KEY)
    with common.small_batches(spark):
        assert spark.conf.get(KEY) == f"{common.BATCH_BYTES}b"
    with pytest.raises(ValueError), common.small_batches(spark):
        raise ValueError
    assert spark.conf.get(KEY) == before
    spark.conf.set(KEY, "1m")
    try:
        with common.small_batches(spark):
            assert spark.conf.get(KEY) == "1m"
    finally:
        spark.conf.set(KEY, before)
