"""plumbline: vector-search quality analytics as declarative Spark plans."""

import sys

from pyspark import cloudpickle

# Python functions of this package travel to the executors by value, so a job
# needs no installation there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
