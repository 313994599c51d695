"""Analytics over fleets of multi-sensor recordings and their trajectories, on Spark."""

import sys

from pyspark import cloudpickle

# Python kernels travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
