"""Two-sided tail of Student's t distribution as a native expression.

P(|T| >= t) with v degrees of freedom equals the regularised incomplete beta function
I_x(v/2, 1/2) at x = v / (v + t^2).  It is evaluated by its continued fraction (Lentz's method,
DLMF 8.17.22) on whichever side of the mean converges fast, so no Python function and no
numerical integration is involved.  Left of the mean and with a parameter of 1/2 all partial
denominators are positive and need no guard against 0.

The text form is one expression for Spark to parse; built node by node it costs seconds of
driver time.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stirling's series at z + 12, walked back by the recurrence of the gamma function.
_LOG_GAMMA = (
    "((({z}) + 11.5D) * ln(({z}) + 12D) - (({z}) + 12D) + 0.5D * ln(2D * pi())"
    " + (1D / 12 - (1D / 360 - (1D / 1260 - 1D / 1680 / pow(({z}) + 12D, 2))"
    " / pow(({z}) + 12D, 2)) / pow(({z}) + 12D, 2)) / (({z}) + 12D)"
    " - ln(aggregate(sequence(0, 11), 1D, (product, i) -> product * (({z}) + i))))"
)

# Partial numerators d_1, d_2, ... of the continued fraction, folded into its value.
_FRACTION = """
aggregate(
  transform(sequence(1, {terms}), j ->
    if(j % 2 = 1,
       -(q.a + (j - 1) / 2D) * (q.a + q.b + (j - 1) / 2D),
       (j / 2D) * (q.b - j / 2D)) * q.x / ((q.a + j - 1D) * (q.a + j))),
  named_struct('c', 1D, 'd', 0D, 'h', 1D),
  (s, n) -> named_struct(
    'c', 1D + n / s.c,
    'd', 1D / (1D + n * s.d),
    'h', s.h * (1D + n / s.c) / (1D + n * s.d)),
  s -> s.h)
"""

_TAIL = """
CASE
  WHEN {t2} = 0 THEN 1D
  WHEN {t2} IS NOT NULL AND {df} IS NOT NULL THEN element_at(
    transform(
      transform(
        array(named_struct('v', double({df}), 't2', double({t2}))),
        r -> if(
          r.v / (r.v + r.t2) < (r.v / 2 + 1D) / (r.v / 2 + 2.5D),
          named_struct('a', r.v / 2, 'b', 0.5D, 'x', r.v / (r.v + r.t2), 'far', true),
          named_struct('a', 0.5D, 'b', r.v / 2, 'x', r.t2 / (r.v + r.t2), 'far', false))),
      q -> if(q.far, 0D, 1D) + if(q.far, 1D, -1D)
        * exp({log_ab} - {log_a} - {log_b} + q.a * ln(q.x) + q.b * log1p(-q.x))
        / q.a / {fraction}),
    1)
END
"""


def two_sided_p(t_squared: str, df: str, terms: int = 80) -> Column:
    """P(|T_df| >= sqrt(t_squared)) over two named columns; null if either is null."""
    return F.expr(
        _TAIL.format(
            t2=t_squared,
            df=df,
            log_ab=_LOG_GAMMA.format(z="q.a + q.b"),
            log_a=_LOG_GAMMA.format(z="q.a"),
            log_b=_LOG_GAMMA.format(z="q.b"),
            fraction=_FRACTION.format(terms=terms),
        )
    )
