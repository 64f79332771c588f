"""Operators for preparing language-model training data, and their queries."""

import sys

from pyspark import cloudpickle

# Executors get the functions of this package with each job; nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
