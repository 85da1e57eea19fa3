"""Structured Streaming: the file-stream learner with table-held state."""
