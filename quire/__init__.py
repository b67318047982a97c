"""quire: ranked recall over large collections of short dated notes, on Spark.

Subpackages
-----------
functions  column expressions (tokenize, parse/render lines, boost, BM25, hashing)
sources    derived input tables, note-file scan/export, table sinks
operators  index, lexical/vector/hybrid search, note edits, vectors, consolidation
plans      the named query catalogue and its DuckDB oracle SQL
streaming  Structured Streaming write feed (append, consolidate, topic counts)
"""

__version__ = "0.1.0"
