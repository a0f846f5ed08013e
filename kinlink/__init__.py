"""Probabilistic record linkage as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value, so that workers need no
# copy of the package on their own path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
