"""Streaming sinks and the runs that feed them."""
