"""Stages: chains of operators that make one result."""
