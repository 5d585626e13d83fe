"""Streaming: intentionally empty.

The original tool has no stream, watermark, window or stateful operator, so nothing is
built here; every operator works on a bounded DataFrame.
"""
