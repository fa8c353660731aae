from churnscope.functions.scalar import (
    baseline_decision, clip, decision, fmt_delta, fmt_money, fmt_mult, fmt_pct,
    risk_tier, round6, round_half_even, safe_ratio, sum_sq,
)

__all__ = [
    "baseline_decision", "clip", "decision", "fmt_delta", "fmt_money", "fmt_mult",
    "fmt_pct", "risk_tier", "round6", "round_half_even", "safe_ratio", "sum_sq",
]
