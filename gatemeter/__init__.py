"""gatemeter: LLM-gateway usage analytics on Spark.

Landed request bodies, responses, SSE captures, request logs and transcripts
become DataFrames; the library derives the one-row-per-call telemetry table
and the reports over it with DataFrame / SQL / streaming APIs.
"""

__version__ = "0.1.0"
