"""Structured Streaming: windows over late data, deduplication, stateful limits and budgets."""
