"""Spark-native analytics over content-addressed, deduplicated snapshots of file collections."""

import sys

from pyspark import cloudpickle

# Functions shipped to executors travel by value, so that only the driver needs this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
