"""tidegrid: dense key-by-hour demand panels on Spark.

Every public function takes and returns Spark DataFrames (or Columns). The
sub-packages are:

``sources``    readers and writers
``functions``  column expressions (calendar, seasonality, weather, metrics, text)
``operators``  DataFrame-to-DataFrame operators
``models``     forecasters, ensembles, back-testing, explanation
``plans``      complete batch jobs put together from the operators
``streaming``  Structured Streaming jobs
``catalog``    the registered queries and their SQL twins
"""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with the task, so that executors need
# no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
