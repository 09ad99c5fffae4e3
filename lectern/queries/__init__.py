"""Registered queries and, where SQL can say them, their SQL."""
