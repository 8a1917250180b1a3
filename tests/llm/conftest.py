import pytest


@pytest.fixture(autouse=True)
def _small_batches(spark):
    from tallymark.llm.queries import prepared

    prepared(spark)
