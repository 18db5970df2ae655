"""Readers: files and folders into typed DataFrames."""
