"""Registered queries and reports."""
