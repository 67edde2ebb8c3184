"""Sums of doubles without rounding, from which terms can be taken away again."""

from __future__ import annotations

import math

# Every finite double is a whole number of 2**-1074.
_BITS = 1074
_ONE = 1 << _BITS


class ExactSum:
    """A running sum that is rounded only when it is read, so its value depends on the terms alone and on no order.

    Adding and removing take the same time however many terms there are. NaN and infinities are counted beside the sum and leave with their terms.
    """

    __slots__ = ("down", "nan", "up", "whole")

    def __init__(self) -> None:
        self.whole, self.nan, self.up, self.down = 0, 0, 0, 0

    def add(self, x: float, times: int = 1) -> None:
        """Add ``x``, or take it away with ``times=-1``."""
        if x - x == 0:
            n, d = x.as_integer_ratio()
            self.whole += times * (n << (_BITS + 1 - d.bit_length()))
        elif x != x:
            self.nan += times
        elif x > 0:
            self.up += times
        else:
            self.down += times

    def plus(self, other: ExactSum, times: int = 1) -> ExactSum:
        out = ExactSum()
        out.whole, out.nan = self.whole + times * other.whole, self.nan + times * other.nan
        out.up, out.down = self.up + times * other.up, self.down + times * other.down
        return out

    def value(self) -> float:
        if self.nan or (self.up and self.down):
            return math.nan
        if self.up or self.down:
            return math.inf if self.up else -math.inf
        try:
            return self.whole / _ONE
        except OverflowError:
            return math.inf if self.whole > 0 else -math.inf
