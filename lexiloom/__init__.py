"""Lexiloom: text search and near-duplicate analytics on Spark DataFrames.

Every operator takes and returns DataFrames.  ``functions`` holds column
expressions, ``sources`` readers and writers, ``operators`` the relational
operators, ``plans`` helpers that shape physical plans (materialised steps,
skew-safe joins, connected components) and the registered queries, and
``streaming`` the incremental index.
"""

__version__ = "0.1.0"
