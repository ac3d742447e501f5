"""The engine's query catalogue: name -> (spark, folder) -> DataFrame, and name -> SQL."""

from . import corpus, documents, indexes, records, search, strict

_PARTS = (search, documents, corpus, records, strict, indexes)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
SQL = {name: sql for part in _PARTS for name, sql in part.SQL.items()}
