"""Evidence retrieval and evaluation analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel by value; nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
