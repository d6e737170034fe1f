"""Keyed objects and vectors as Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel by value, so that workers need not find this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
