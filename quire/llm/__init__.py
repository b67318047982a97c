"""Operators of a training-data pipeline over ``documents``: quality rules,
near- and substring-deduplication, secret scans, tokenisation, packing,
language identification, sharding and exact vector search. Nothing else in
the library imports this subpackage."""
