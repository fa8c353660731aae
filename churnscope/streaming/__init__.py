from churnscope.streaming.ingest import (
    clean_stream, events_stream, ingest, read_table_stream, score_requests,
)

__all__ = ["clean_stream", "events_stream", "ingest", "read_table_stream", "score_requests"]
