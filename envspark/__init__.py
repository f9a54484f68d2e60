"""envspark — station-based environmental time-series analytics on Spark.

Every public function maps DataFrames (plus an explicit ``as_of`` time) to a
DataFrame.  Nothing collects to the driver; all work is one Spark plan keyed by
``(station_id, metric)`` or ``grid_point_id``.
"""

__version__ = "0.1.0"
