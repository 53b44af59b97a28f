"""Operators for training-data corpora, one module per operator."""

import sys

from pyspark import cloudpickle

# Executors get the functions with the tasks, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
