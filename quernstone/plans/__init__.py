"""Whole queries and pipelines put together from operators."""
