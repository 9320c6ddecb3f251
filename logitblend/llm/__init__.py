"""Operators that a pipeline for training data needs."""

import sys

from pyspark import cloudpickle

# Python functions travel to the executors with their code, so that the executors need
# no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
