"""Operators for training-data pipelines. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Executors get the Python code inside the closures, so nothing need be installed on them.
cloudpickle.register_pickle_by_value(sys.modules["symbolgraph"])
