"""Data preparation and data-quality jobs written as Spark DataFrame operations."""

import sys

from pyspark import cloudpickle

# Functions of this package that run in Python workers travel with the query, so executors
# need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
