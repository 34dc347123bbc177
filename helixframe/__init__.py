"""helixframe: labelled-sequence analytics as Spark DataFrame plans.

Sub-packages:
  sources    readers and writers (CSV pair tables, line records, FASTA, split
             indexes, vocabularies, metric records)
  functions  Column-expression builders (overlap words, padding, softmax, ...)
  operators  DataFrame -> DataFrame operators (splits, ranks, tokens, vectors,
             metrics, Spark ML models)
  plans      the registered queries and their SQL oracles
  streaming  the per-row operators on Structured Streaming sources
"""

import sys

from helixframe.session import get_session, scratch_path

# Ship this package's functions (pandas UDF bodies, model loaders) to the
# Python workers by value, so executors need no installed copy of it.
try:
    from pyspark import cloudpickle as _cp
    _cp.register_pickle_by_value(sys.modules[__name__])
except Exception:  # noqa: BLE001 - older pyspark: workers must import the package
    pass

__all__ = ["get_session", "scratch_path"]
