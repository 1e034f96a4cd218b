"""Training-data operators: each is a function from DataFrames to DataFrames.

The functions that run inside tasks are pickled by value, so executors need only the installed
third-party libraries, not this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
