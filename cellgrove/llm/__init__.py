"""Operations of a training-data pipeline: deduplication, filtering, tokens.

Nothing outside this folder imports it.  Each operator module keeps a general
interface of its own; ``queries`` derives the digest columns from it.
"""
import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with their source, so executors need
# no copy of this package on their own path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
