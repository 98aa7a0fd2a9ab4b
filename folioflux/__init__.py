"""folioflux: a Spark-native retrieval, document-analytics and corpus-preparation engine."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions travel to executors by value, so the package needs no installation there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
