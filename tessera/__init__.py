"""tessera: a PySpark-native engine for dependency-binding analytics.

Every operator is a function over DataFrames; nothing is collected to the
driver except results whose size has a stated bound.
"""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job, so executors need no
# copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
