"""Readers of the star tables and the product lists, and the CSV report sink."""
