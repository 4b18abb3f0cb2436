"""foliolake: ordered document text as Spark DataFrames.

Blocks of text are rows keyed by ``(doc_id, ordinal)``; readers, filters,
joins, aggregations and writers are DataFrame plans over them.
"""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with their code, so that workers
# need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
