from .exprs import (  # noqa: F401
    as_double,
    average_money,
    cents,
    cents_sum,
    cents_to_double,
    count_true,
    money,
    month_label,
    month_start,
    pct,
    ratio,
    round_half_even,
    round_half_up,
    rounded,
    rows,
    share_true,
)
