"""Data-protection analytics for AI traffic, expressed as Spark DataFrame jobs."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# the few Python functions used inside tasks travel with the job; executors need no installed copy
register_pickle_by_value(sys.modules[__name__])
