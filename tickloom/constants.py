"""Production parameters of the study."""

from __future__ import annotations

import math

# Fixed values that results depend on.
BARRIER = 0.0060
HORIZON = 3600
WINDOW_SIZE = 300
PI_FACTOR = math.pi / 2
EPSILON = 1e-8
BPS = 1e-4
SECONDS_PER_DAY = 86_400
TRADING_DAYS = 365
MEASURED_SLIPPAGE_BPS = 0.076
TICK_SIZE = 0.01
TAKER_FEE_BPS = 2.5
MAKER_FEE_BPS = 0.0
QUEUE_AHEAD = 1.0
MAX_WAIT = 5
ORDER_SIZE = 0.1
VAL_OVERHEAD = 1.25
LABEL_MODES = ("triple_barrier", "barrier_touched")
SCHEMES = ("anchored", "rolling", "holdout")
CHANNELS = ("log_return", "realized_var", "bipower", "ofi", "log_volume", "log_trades")
CHANNEL_SETS = {"raw": ("log_return", "ofi"), "full": CHANNELS}
FEATURES = ("realized_variance", "bipower_variation", "jumps", "order_flow", "lookback_return", "vol_adjusted_ofi", "signed_jumps")


def purge_length(window: int = WINDOW_SIZE, horizon: int = HORIZON) -> int:
    """Windows that overlap a boundary by look-back or label."""
    return window + horizon - 1
