"""Store insights as Spark jobs: pages, catalogues and records in, store reports out."""

import sys

from pyspark import cloudpickle

# Functions travel to the Python workers by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
