"""A PySpark engine for labelled three-dimensional point patterns in many samples."""
import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with their source.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
