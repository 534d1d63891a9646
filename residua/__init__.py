"""Spark-native analytics for screening and curating biological sequences."""

import sys

from pyspark import cloudpickle

# Executors need no copy of this package: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
