"""PySpark-native analytics over evidence graphs: corpora, retrieval, navigation, rewards and credit."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run on executors are sent by value: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
