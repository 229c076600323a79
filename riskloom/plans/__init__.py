"""Whole plans: from diffs to scores, and the registered queries."""
