"""strideframe: features of long ordered signals, and model validation, on Spark DataFrames.

A *series table* has the columns ``series_id STRING, pos BIGINT, x DOUBLE`` and optionally a
label ``ttf DOUBLE``; ``pos`` counts 0, 1, 2, ... inside each series.  Every operator takes and
returns DataFrames, and none of them ever needs all rows of a series in one task.
"""

import sys

from pyspark import cloudpickle

# functions that run inside tasks travel with the plan, so that executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
