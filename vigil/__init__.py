"""Security-event analytics as DataFrame-to-DataFrame operators on Spark."""

import sys

from pyspark import cloudpickle

# The few Python functions that run in tasks travel with the job, so executors need no installation.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
