"""Streams: micro-batches, rates and guards."""
