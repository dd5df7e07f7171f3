"""scour: clean, reshape, profile and validate tables as ordinary Spark jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package travel to the executors with the job; nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
