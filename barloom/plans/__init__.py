"""Compositions of operators: studies, and the registered queries."""
