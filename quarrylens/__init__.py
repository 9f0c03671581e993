"""Spark-native table analysis: lazy DataFrame operators for profiling, cleaning,
transforming, testing and summarising tables."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

from quarrylens.errors import EngineError

__all__ = ["EngineError"]

# Functions of this package travel to the executors by value, so that these need not have it
# installed.
register_pickle_by_value(sys.modules[__name__])
