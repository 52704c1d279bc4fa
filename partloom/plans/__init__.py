"""Queries: what each one reads, the operators it applies, and its SQL twin."""
