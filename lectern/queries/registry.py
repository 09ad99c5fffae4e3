"""All queries outside the llm subpackage."""

from __future__ import annotations

from lectern.queries import general, reference, service

QUERIES = {**reference.QUERIES, **service.QUERIES, **general.QUERIES}
ORACLE = {**reference.ORACLE, **service.ORACLE, **general.ORACLE}
FLAGSHIP = QUERIES["srt_documents"]
