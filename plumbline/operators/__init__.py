"""Distributed profiling and inspection operators."""
