"""Registered operators and queries, workflows, intermediate tables."""
