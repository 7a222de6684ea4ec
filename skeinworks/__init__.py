"""skeinworks: a PySpark-native dataframe wrangling and data-preparation engine.

Sub-packages: ``operators`` (DataFrame -> DataFrame), ``sources`` (readers and
writers), ``functions`` (column expressions and table functions), ``plans``
(fused pipelines and the registered queries), ``streaming`` (Structured
Streaming counterparts).
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions of this package travel to the Python workers by value, so that executors need no copy of it.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
