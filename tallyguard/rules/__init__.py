"""Declarative compliance rules and their evaluation."""
