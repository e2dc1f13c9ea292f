"""Cross-market interaction sequences on Spark.

Raw market files become clean per-market tables, item vectors, user sequences, a leave-one-out split, candidates,
batch scores and ranking metrics. Everything takes and returns DataFrames.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# The Arrow functions of this package travel with the job, so executors need no installed copy of it.
register_pickle_by_value(sys.modules[__name__])
