"""Training-data operators: one module an operator, queries in ``queries.py``.

Nothing outside this folder, ``corpus_pipeline.py`` and the guarded import in
``__spark_entry__.py`` uses it.
"""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to the executors by value: nothing need be
# installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
