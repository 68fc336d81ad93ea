"""Operators of a training-data pipeline, each a function from DataFrames to a DataFrame.

Functions that run inside Python workers are pickled by value, so executors need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
