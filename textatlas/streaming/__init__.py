"""Structured Streaming: keyword search over files as they arrive. An extension; batch results are the same."""
