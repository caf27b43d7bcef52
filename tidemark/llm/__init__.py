"""Operators for preparing language-model training data at corpus scale."""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to executors by value, so nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
