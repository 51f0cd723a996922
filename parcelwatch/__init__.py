"""Risk analytics over corpora of published software packages, as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# The few Python helpers travel to executors inside the plan, so no executor needs this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
