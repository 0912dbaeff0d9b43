"""Structured Streaming forms of imports, queue state, rates and phase timings."""
