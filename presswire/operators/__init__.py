"""Operators on items, requests and articles."""
