"""Composite workloads built from the operators."""
