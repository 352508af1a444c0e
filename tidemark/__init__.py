"""Cleaning, profiling and analysis of messy tables on Spark."""

import sys

from pyspark import cloudpickle

# Functions of this package travel with the job by value, so executors need no
# installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
