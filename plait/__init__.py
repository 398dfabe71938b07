"""plait: a PySpark-native analytics engine (see README.md)."""

import sys

from pyspark import cloudpickle

# Python functions go to the executors by value: they need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
