"""Run parameters in one frozen dataclass.

Every operator that needs a clock takes ``as_of`` from here instead of calling
``current_date()``, so results are reproducible.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field, replace


def default_holidays(first_year: int = 1995, last_year: int = 2001) -> tuple[dt.date, ...]:
    # Holiday month/day pairs used for the fixtures
    # (1 Jan, 1 May, 9 Aug, 25 Dec), repeated for every year in the range.
    month_days = [(1, 1), (5, 1), (8, 9), (12, 25)]
    return tuple(dt.date(y, m, d) for y in range(first_year, last_year + 1) for m, d in month_days)


@dataclass(frozen=True)
class Params:
    as_of: dt.date = dt.date(2001, 8, 1)
    days_back: int = 365          # trailing window of the demand series
    horizon: int = 14             # forecast / hold-out length
    safety_factor: float = 1.2
    n_lags: int = 30
    urgent_days: int = 2
    warning_days: int = 7
    min_points: int = 10          # distinct demand days for eligibility
    min_train: int = 30           # minimum training rows
    train_points: int = 30        # observed days that training a part needs
    single_days: int = 30         # demand days that a single-series model needs
    heavy_txn_lines: int = 8      # "heavy transaction" line limit
    void_scope: str = "both"      # "both" | "header"
    ses_alpha: float = 0.3
    croston_alpha: float = 0.1
    on_time_tolerance: int = 2
    default_lead_time: int = 7
    top_n: int = 20
    holidays: tuple = field(default_factory=default_holidays)
    gbt_trees: int = 100
    gbt_depth: int = 5
    gbt_lr: float = 0.1
    loss_trees: int = 20          # rounds and learning rate of boosting with own losses
    loss_rate: float = 0.3
    seed: int = 42

    def with_(self, **kw) -> "Params":
        return replace(self, **kw)


# The events-based demand sources cover 30 days ending 2024-01-30.
EVENTS_PARAMS = Params(as_of=dt.date(2024, 1, 30), days_back=30, min_train=14, train_points=3,
                       holidays=(dt.date(2024, 1, 1),))
