"""Spark jobs over LLM traffic: usage, cost, limits, failures and personal data."""
