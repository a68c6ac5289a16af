"""Queries over the driver's tables, each with the same rows in SQL where SQL can express them."""
