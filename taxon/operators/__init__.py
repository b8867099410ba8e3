"""Relational operators: joins, profiles, metrics, rankings, splits and text vectors."""
