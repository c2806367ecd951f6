"""Parameters of the analytics (fixed values where results depend on them)."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    risk_free: float = 0.04  # a year
    periods: int = 365  # a year, for every asset
    vol_window: int = 30
    corr_windows: tuple[int, int] = (30, 90)
    ma_short: int = 50
    ma_long: int = 200
    full_history: int = 300  # rows from which the full windows apply
    rsi_window: int = 14
    horizon: int = 30
    test_share: float = 0.15
    min_test: int = 10
    stress_quantile: float = 0.10
    min_coverage: float = 0.5
    regime_cuts: tuple[float, float] = (0.33, 0.66)
    min_regime_rows: int = 5
    min_corr_rows: int = 3
    min_stress_rows: int = 20
    rsi_strong: float = 55.0
    rsi_weak: float = 45.0
    near_high: float = -0.10
    deep: float = -0.25
    basing: float = -0.30
    alpha: float = 0.20  # forecast intervals cover 1 - alpha
    lookback: int = 120
    history_days: tuple[int, ...] = (90, 180, 270, 365)
    cache_hours: float = 6.0


DEFAULT = Settings()

_SHARES = ("test_share", "stress_quantile", "min_coverage", "alpha", "regime_cuts")
_ANY = ("risk_free", "near_high", "deep", "basing")  # all others are positive


def problems(values: Mapping[str, object]) -> list[str]:
    """All that keeps `values` from being settings: names that are absent or unknown, kinds and ranges that do not fit."""
    known = {f.name: getattr(DEFAULT, f.name) for f in fields(Settings)}
    found = [f"{name} is missing" for name in known if name not in values] + [f"{name} is unknown" for name in values if name not in known]
    for name, default in known.items():
        if name not in values:
            continue
        value = values[name]
        several = isinstance(default, tuple)
        own, model = (value if several and isinstance(value, (tuple, list)) else [value]), (default[0] if several else default)
        whole = isinstance(model, int)
        if several and (not isinstance(value, (tuple, list)) or not value or (name != "history_days" and len(value) != len(default))):
            found.append(f"{name} must be a sequence like {default}")
        elif not all(isinstance(x, int if whole else (int, float)) and not isinstance(x, bool) for x in own):
            found.append(f"{name} must be {'whole' if whole else 'numeric'}")
        elif name in _SHARES and not all(0 < x < 1 for x in own):
            found.append(f"{name} must lie between 0 and 1")
        elif name not in _ANY and not all(x > 0 for x in own):
            found.append(f"{name} must be positive")
        elif several and list(own) != sorted(own):
            found.append(f"{name} must ascend")
    if not found and values["ma_short"] >= values["ma_long"]:
        found.append("ma_short must be below ma_long")
    return found


def checked(values: Mapping[str, object]) -> Settings:
    """Settings from a mapping, such as a file's; an error names every problem at once."""
    if found := problems(values):
        raise ValueError("; ".join(found))
    return Settings(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})

#: Symbols by provider id, and macro assets by ticker (fixed values).
CRYPTO_ASSETS = {"bitcoin": "BTC", "ethereum": "ETH", "solana": "SOL", "binancecoin": "BNB", "ripple": "XRP", "cardano": "ADA"}
MACRO_ASSETS = {"^GSPC": "S&P 500", "GC=F": "Gold", "DX-Y.NYB": "US Dollar Index", "^TNX": "US 10Y Yield", "CL=F": "Crude Oil"}
RATE_ASSETS = frozenset({"US 10Y Yield"})
BENCHMARK = "S&P 500"


def ma_windows(n: int, s: Settings = DEFAULT) -> tuple[int, int]:
    """(short, long) moving-average windows for a history of n rows."""
    if n >= s.full_history:
        return s.ma_short, s.ma_long
    long_ = max(20, n // 3)
    return max(5, long_ // 4), long_
