"""Structured requests, and the queries registered for checking."""
