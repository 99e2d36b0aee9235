"""Well-log analytics on Spark: scans, pixel and curve operators, pairing, labelling, evaluation and learning as DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks are sent whole, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
