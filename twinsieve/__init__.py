"""Near-duplicate analytics on Spark."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry this package's code with them: nothing to install there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
