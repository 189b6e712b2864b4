"""Contact-matrix analytics and corpus preparation, written as Spark jobs.

Kernels that run inside ``mapInArrow``/``applyInPandas`` are shipped to the executors by value,
so a cluster does not need this package installed next to its Python workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
