"""Lazy DataFrame operators, from star tables to ranked comparisons."""
