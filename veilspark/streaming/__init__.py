"""Stateful anonymisation cores and their batch and streaming adapters."""
