"""scoreloom: graded free-text answer analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The few Python helpers that run in tasks travel with the job, so the package
# has to be installed on the driver only.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
