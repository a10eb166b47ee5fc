"""Structured Streaming variant of the batch scoring job."""

from buyerlens.streaming.scoring_stream import start_scoring_stream  # noqa: F401
