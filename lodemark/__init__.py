"""lodemark: geospatial click analytics as Spark DataFrame transforms.

Functions that run in Python workers are sent by value, so that workers need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
