"""Structured Streaming: period sums that follow files as they arrive."""
