"""Training-data operators over documents, vectors and pages.

Functions of this package travel to the executors by value, so tasks need no copy of it there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
