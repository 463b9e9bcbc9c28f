"""Composed jobs (X0, X0b, X0c) and reports."""
