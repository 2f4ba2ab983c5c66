"""Operators for preparing training data: thirteen methods, their queries and SQL.

Nothing outside this folder, ``tests/llm`` and ``corpus_pipeline.py`` imports it.
"""

import sys

from pyspark import cloudpickle

# Functions of this folder travel to the executors as code, so that the package
# need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
