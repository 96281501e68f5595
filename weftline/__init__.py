"""A PySpark-native engine for composable table pipelines."""

import sys

from pyspark import cloudpickle

# Python workers get the engine's functions by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
