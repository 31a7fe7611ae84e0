"""Whole studies and reports as one plan."""
