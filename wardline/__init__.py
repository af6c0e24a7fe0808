"""Behavioural anomaly and drift analytics over access logs, on Spark."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to Python workers by value, so a driver-only
# install is enough.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
