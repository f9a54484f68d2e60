"""The summary of a single day against the job over all days."""

import re
from datetime import timedelta

from envspark.plans.daily_summary import daily_summary, summary_of_day
from envspark.sources.binding import AS_OF, Bound
from tests.conftest import SF_SMALL


def _rows(df):
    return sorted(map(str, df.collect()))


def test_one_day_equals_its_rows_of_all_days(spark):
    b = Bound(spark, SF_SMALL)
    every = daily_summary(b.aq, b.wx, b.stations)
    yesterday = AS_OF.date() - timedelta(days=1)
    one = summary_of_day(b.aq, b.wx, b.stations, AS_OF)
    assert _rows(one) == _rows(every.where(every.summary_date == yesterday)) and one.count() > 0
    before = yesterday - timedelta(days=5)
    assert _rows(summary_of_day(b.aq, b.wx, b.stations, AS_OF, before)) == _rows(every.where(every.summary_date == before))
    scans = re.findall(r"FileScan parquet.*DataFilters: \[(isnotnull.*?), Format", one._jdf.queryExecution().executedPlan().toString())
    assert scans and all(re.search(r"ts#\d+ >= 2024-01-30 00:00:00\), \(ts#\d+ <", s) for s in scans)  # the day reaches both scans
