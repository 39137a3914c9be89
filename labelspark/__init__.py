"""labelspark: multi-label text datasets and their evaluation as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers carry their code with them, so executors
# need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
