"""Structured Streaming jobs. Micro-batches reuse the batch operators through ``foreachBatch``."""
