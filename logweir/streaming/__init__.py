"""Structured Streaming sources and jobs."""
