"""Every registered query of the library against DuckDB on the smallest tables."""

import datetime

import oracle
import pytest

from trackweave.plans import catalogue


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_query(spark, sf_dir, con, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    if name in catalogue.ORACLES:
        assert oracle.differences(df, con, catalogue.ORACLES[name]) == ""
    else:
        assert df.count() > 0


def test_under_way_on_odd_events(spark, tmp_path):
    """Seconds are rounded as SQL rounds them, half to even; ids occur twice or are missing."""
    second = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    # values whose seconds lie just below a whole number, or halfway between two
    values = [0.29, 0.57, 1.15, 2.3, 0.5 / 3600, 1.5 / 3600, 2.5 / 3600, 0.0, -1.0, None, 30.0]
    rows = [(100 * i, second(20_000 * i), 1, "view", v, None) for i, v in enumerate(values)]
    for i, v in enumerate(values):
        rows += [(100 * i + 1 + k, second(20_000 * i + round((v or 0) * 3600) + k - 1.5), 1, "view", 0.0, None) for k in range(4)]
    rows += [(7, second(5), 1, "view", 3.0, None), (7, second(6), 2, "view", 1.0, None), (None, second(7), 1, "view", 50.0, None), (None, second(8), 2, "view", 1.0, None), (9, second(9), None, "view", 1.0, None), (10, None, 1, "view", 1.0, None)]
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/events.parquet")
    assert oracle.differences(catalogue.QUERIES["under_way"](spark, str(tmp_path)), oracle.connect(str(tmp_path)), catalogue.ORACLES["under_way"]) == ""


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
