"""riskloom: risk analytics on Spark DataFrames.

``sources``   readers and sinks
``functions`` column expressions
``operators`` DataFrame in, DataFrame out
``plans``     whole jobs made of operators
``streaming`` Structured Streaming jobs
"""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Functions sent to the executors travel by value: the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
