"""Percentages and two-decimal rounding that agree with Python's ``round``.

Expressions are SQL text: one parse per expression costs far less on the driver than a
JVM call per operator.
"""

from __future__ import annotations

_STEPS = 2**62


def round2(value: str) -> str:
    """``round(value, 2)`` for a double in [0, 2**31): exact binary value, half to even.

    Spark's ``round`` and ``bround`` look at the shortest decimal text of a double, so
    2.675 (stored as 2.67499...) becomes 2.68. Here the binary fraction is compared as
    an integer count of 2**-62 steps.
    """
    value = f"cast({value} as double)"
    scaled = f"cast(cast(({value} - floor({value})) * {float(_STEPS)}D as bigint) as decimal(20,0)) * 100"
    cents = f"cast(floor(({scaled}) / {_STEPS}) as bigint)"
    rest = f"(({scaled}) - cast({cents} as decimal(10,0)) * {_STEPS})"
    up = f"cast({rest} > {_STEPS // 2} or ({rest} = {_STEPS // 2} and {cents} % 2 = 1) as int)"
    return f"(cast(cast(floor({value}) as bigint) * 100 + {cents} + {up} as double) / 100D)"


def percentage(part: str, total: str, empty: float | str = 100.0) -> str:
    """``part / total`` as a percentage with two decimals; ``empty`` where total is 0."""
    share = f"try_divide(cast({part} as double), cast({total} as double)) * 100D"
    return f"case when {total} = 0 then cast({empty} as double) else {round2(share)} end"
