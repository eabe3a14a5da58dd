"""Whole workloads: every module registers its queries."""
