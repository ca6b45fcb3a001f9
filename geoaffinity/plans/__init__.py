"""The three analyses end to end."""
