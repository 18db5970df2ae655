"""Pluggable models and language-model clients."""
