"""Registered queries: each reads whole tables and, where SQL can say the same, carries that SQL."""
