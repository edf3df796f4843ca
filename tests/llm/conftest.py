import pytest


@pytest.fixture(autouse=True)
def few_partitions(request):
    """The fixtures here are tiny: two shuffle partitions instead of the suite's eight."""
    if "spark" not in request.fixturenames:
        yield
        return
    spark = request.getfixturevalue("spark")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)
