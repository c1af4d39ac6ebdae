"""Exploratory data analysis operators as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so workers need neither the package nor its folder.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.2.0"
