"""glossmill: a Spark-first engine for building, querying and cleaning multilingual lexicons."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel whole, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
