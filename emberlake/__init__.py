"""Emberlake: a PySpark engine for event-sourced agent memory and corpus preparation."""
