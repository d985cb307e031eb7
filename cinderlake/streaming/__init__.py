"""Micro-batch jobs on Structured Streaming."""
