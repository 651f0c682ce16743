"""Data-pipeline operators for Spark: topics, keyed tables, object sets, text,
layered configuration and status roll-ups, all as DataFrame expressions."""

import sys

from pyspark import cloudpickle

# Tasks receive the library's functions by value: executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
