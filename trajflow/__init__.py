"""Check-in and trajectory analytics on Spark DataFrames.

``sources`` reads and writes the data, ``operators`` holds the analytics,
``functions`` the column helpers they share, ``plans`` the named queries that
run the operators over the event tables.
"""

import sys

from pyspark import cloudpickle

# Task functions travel with their code, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
