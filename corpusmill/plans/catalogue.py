"""Imports every query module so that the registry is complete."""

from corpusmill.plans import catalog_queries, chat_queries, chunk_queries, page_queries, search_queries, similar_queries, source_queries, stream_queries, sync_queries, table_function_queries, text_queries, topic_queries  # noqa: F401
from corpusmill.plans.registry import ORACLES, QUERIES, SURVEY_ROWS  # noqa: F401
