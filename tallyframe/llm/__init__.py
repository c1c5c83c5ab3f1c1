"""Operators for preparing training data: text, tokens, duplicates, quality, mixing and search."""

import sys

from pyspark import cloudpickle

# The functions that run in tasks travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
