"""Compositions of operators: whole analyses, and how large sides of joins are handled."""
