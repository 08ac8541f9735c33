"""Readers and writers: stored candle tables, landed messages and pages, exports."""
