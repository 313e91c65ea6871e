"""gleaner: a PySpark-native engine for searching and analysing code and text corpora."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with their code, so workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
