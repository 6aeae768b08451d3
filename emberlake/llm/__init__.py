"""Training-data operators. Nothing outside this subpackage imports it.

Functions that run in Python workers travel with the job instead of being imported
on the executors, so a cluster needs no copy of this repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
