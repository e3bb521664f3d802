"""Structured Streaming: the job queue, count-or-timeout batches, progress."""
