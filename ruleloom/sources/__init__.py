"""Fact and rule files, and sinks."""
