"""tidewatt: regular time series, demand forecasts and growth scenarios as Spark plans."""

import sys

from pyspark.cloudpickle.cloudpickle import register_pickle_by_value

# The few functions that run in Python tasks travel with the task, so that executors
# need not have this package installed.
register_pickle_by_value(sys.modules[__name__])
