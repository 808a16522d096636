"""framewright: signal, frame-sequence and serving-telemetry analytics on PySpark."""

import sys

from pyspark import cloudpickle

# Task functions travel by value, so workers need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
