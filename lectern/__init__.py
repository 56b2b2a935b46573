"""Document-corpus analytics as Spark plans."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with the job, so that workers need no installation of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
