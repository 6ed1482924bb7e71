"""The queries of this subpackage and their SQL."""

from mundspark.llm import queries_mix, queries_rows, queries_text, queries_transcripts

_PARTS = (queries_text, queries_rows, queries_transcripts, queries_mix)
QUERIES = {name: q for m in _PARTS for name, q in m.QUERIES.items()}
SQL = {name: s for m in _PARTS for name, s in m.SQL.items()}
