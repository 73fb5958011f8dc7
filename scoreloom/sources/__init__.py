"""Readers that end in the graded-answer columns."""
