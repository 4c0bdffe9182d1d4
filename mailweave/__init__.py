"""PySpark-native analytics for mail threads, retrieval chunks and conversation turns."""

import sys

from pyspark import cloudpickle

# Tasks carry the functions they run, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
