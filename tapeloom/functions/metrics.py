"""Exact execution metrics in ticks.

Prices are whole 1e-9 units, so numerators and denominators are whole numbers and one division ends a
metric. ``fills`` is an array of struct(price, qty); ``mid2`` is twice a mid price.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapeloom.sources.schemas import MULTIPLIER, TICK


def _sum(fills: Column, term) -> Column:
    return F.aggregate(fills, F.lit(0).cast("long"), lambda a, f: a + term(f))


def shortfall_gross(side: Column, fills: Column, m0_mid2: Column, tick: int = TICK) -> Column:
    """s * sum q (2 p - m0) / (2 Q tick): positive is worse than the reference mid. Null without fills."""
    qty = _sum(fills, lambda f: f["qty"])
    return F.when(qty > 0, (side * _sum(fills, lambda f: f["qty"] * (2 * f["price"] - m0_mid2))) / (2 * qty * tick))


def shortfall_net(side: Column, fills: Column, m0_mid2: Column, fees: Column, tick: int = TICK, multiplier: int = MULTIPLIER) -> Column:
    """The gross shortfall with fees, as one fraction."""
    qty = _sum(fills, lambda f: f["qty"])
    top = side * _sum(fills, lambda f: f["qty"] * (2 * f["price"] - m0_mid2)) * multiplier + 2 * fees
    return F.when(qty > 0, top / (2 * qty * tick * multiplier))


def markout(side: Column, price: Column, future_mid2: Column, tick: int = TICK) -> Column:
    return side * (future_mid2 - 2 * price) / (2 * tick)


def benchmark_offset(side: Column, z0_mid2: Column, m0_mid2: Column, tick: int = TICK) -> Column:
    return side * (z0_mid2 - m0_mid2) / (2 * tick)


def deadline_value(side: Column, fills: Column, fees: Column, z0_mid2: Column, mt_mid2: Column, tick: int = TICK, multiplier: int = MULTIPLIER) -> Column:
    """Cost of one contract at its deadline, against z0: what was filled, fees, and the rest at mT. The
    rest carries no fee."""
    qty = _sum(fills, lambda f: f["qty"])
    moved = _sum(fills, lambda f: f["qty"] * (2 * f["price"] - z0_mid2)) + (1 - qty) * (mt_mid2 - z0_mid2)
    return (side * moved * multiplier + 2 * fees) / (2 * tick * multiplier)


def mid2_to_price(mid2: Column) -> Column:
    """For display only."""
    return mid2 / 2e9


def limit_offset(side: Column, limit: Column, touch: Column, tick: int = TICK) -> Column:
    """How many ticks a limit is behind its touch: positive is less aggressive."""
    return side * (touch - limit) / tick


def tick_aligned(price: Column, tick: int = TICK) -> Column:
    """Whether a price is a whole number of ticks; of negative prices too."""
    return F.pmod(price, F.lit(tick)) == 0


def checkpoint_eligibility(status: Column, pending: Column, cancel_pending: Column, rejected: Column, controller: Column, executed: Column) -> Column:
    """What a policy may decide at its checkpoint; the first rule that fits."""
    return (
        F.when(status == "FILLED", "REPORTED_COMPLETE").when(pending | cancel_pending | (status == "IN_FLIGHT"), "INELIGIBLE_PENDING").when(rejected | (status == "REJECTED"), "INELIGIBLE_REJECTED")
        .when(controller | (status != "WORKING"), "INELIGIBLE_NOT_WORKING").when(executed != 0, "INELIGIBLE_PARTIAL").otherwise("MODEL_CHOICE")
    )


def price_rule_choice(side: Column, signal: Column, theta: Column) -> Column:
    """SWITCH where side * signal is over theta, HOLD else; a missing or nonfinite signal switches."""
    bad = signal.isNull() | F.isnan(signal) | (F.abs(signal) == float("inf"))
    return F.when(bad | (side * signal > theta), "SWITCH").otherwise("HOLD")


def softmax(*z: Column) -> list[Column]:
    """Shifted by the largest, so no exponent overflows."""
    top = F.greatest(*z)
    e = [F.exp(x - top) for x in z]
    total = sum(e[1:], e[0])
    return [x / total for x in e]


def sigmoid(z: Column) -> Column:
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))
