"""Spark-native terminology analytics: extraction, verification, reports, glossary tools and training-data operators."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package travel to the executors by value, so that no executor needs the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
