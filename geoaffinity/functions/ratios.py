"""Ratios that never produce NaN or infinity, as SQL expression text over column names."""


def share(part: str, whole: str) -> str:
    """part / whole in double precision, null where it is undefined."""
    return f"try_divide(double({part}), double({whole}))"


def guarded_ratio(numerator: str, denominator: str) -> str:
    """numerator / denominator, 0 where it is undefined."""
    return f"coalesce({share(numerator, denominator)}, 0D)"


def lift(metric: str, baseline: str) -> str:
    """Relative difference to the baseline, null where the baseline is 0."""
    return f"CASE WHEN {baseline} <> 0 THEN {metric} / {baseline} - 1 END"


def feature_key(category: str, feature: str) -> str:
    """'category: feature', null where either part is null."""
    return f"{category} || ': ' || {feature}"
