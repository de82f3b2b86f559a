"""Motion matching at batch and streaming scale, on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Task code travels with the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
