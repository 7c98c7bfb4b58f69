"""Spark-native indexing and search over source-code corpora."""

import sys

from pyspark import cloudpickle

# Ship the few Python helpers with the plan, so executors need no installation.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
