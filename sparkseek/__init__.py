"""A text-retrieval, link-analysis and corpus engine on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel whole, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
