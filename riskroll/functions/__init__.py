from riskroll.functions.exprs import (  # noqa: F401
    date_mean,
    days_between,
    hash_uniform,
    hash_unit,
    is_date_type,
    is_numeric_type,
    lenient_date,
    round_doubles,
    safe_div,
)
