"""Fleet telemetry analytics on Spark."""

import sys

from pyspark import cloudpickle

# Functions that run on the executors travel with the job by value, so no executor needs the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
