from starling.functions.columns import (  # noqa: F401
    bin_number, clip, flag, half_even, month_of, name_of, not_null, percent, risk_tier, safe_ratio,
    significance_text, whole_days,
)
