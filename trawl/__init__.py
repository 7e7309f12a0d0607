"""trawl: a PySpark-native engine for search and text analytics.

Every operator takes DataFrames and returns a DataFrame; see README.md for the layout.
"""

import sys

from pyspark import cloudpickle

# Python workers get the package's functions by value, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
