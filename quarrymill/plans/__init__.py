"""Composite plans and registered queries."""
