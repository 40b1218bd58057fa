"""Composite plans: whole analyses built from the operators."""
