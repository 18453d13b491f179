"""Operators for preparing training text at corpus scale, their queries and their SQL."""
