"""Number formats of the presented tables, as SQL expression text over column names."""

SMALL_SAMPLE_NOTE = "Sample size too small to conduct ANOVA"


def thousands(x: str) -> str:
    """1234567.8 -> 1,234,568"""
    return f"format_number({x}, 0)"


def dollars(x: str) -> str:
    """1234.5 -> $1,234.50"""
    return f"'$' || format_number({x}, 2)"


def two_decimals(x: str) -> str:
    """1234.5 -> 1,234.50"""
    return f"format_number({x}, 2)"


def percent(x: str) -> str:
    """12.345 -> 1234.50%"""
    return f"replace(format_number({x} * 100, 2), ',', '') || '%'"


def p_value(x: str) -> str:
    """Two decimals, or a note where no test could be made."""
    return f"coalesce(format_number({x}, 2), '{SMALL_SAMPLE_NOTE}')"
