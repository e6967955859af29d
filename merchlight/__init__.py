"""merchlight: sales and operations analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel by value: executors need no copy of
# this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
