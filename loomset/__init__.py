"""Instruction-data preparation, scoring and telemetry analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# The few Arrow functions travel with their helpers: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
