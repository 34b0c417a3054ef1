"""Spark-native sequence deduplication, alignment and similarity analytics."""

import sys

from pyspark import cloudpickle

# Functions run inside tasks travel with the task, so executors need no copy of this
# package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
