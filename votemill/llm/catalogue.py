"""The queries of this subpackage by name, and their SQL."""

from votemill.llm import history_queries, label_queries, text_queries

QUERIES = {**label_queries.QUERIES, **history_queries.QUERIES, **text_queries.QUERIES}
SQL = {**label_queries.SQL, **history_queries.SQL, **text_queries.SQL}
