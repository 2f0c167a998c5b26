"""A small seeded generator for draws that the driver makes."""

from __future__ import annotations

_MASK = (1 << 64) - 1


class Xoroshiro128:
    """xoroshiro128+ with shifts 55, 14, 36, its state filled by xorshift64*; the same draws everywhere."""

    #: Fixed values of the two published generators.
    ROTATE, SHIFT, ROTATE_LAST = 55, 14, 36
    SEED_SHIFTS = (12, 25, 27)
    SEED_FACTOR = 2685821657736338717
    SEED_FOR_ZERO = 4101842887655102017

    def __init__(self, seed: int = 123456789):
        state = (seed & _MASK) or self.SEED_FOR_ZERO
        a, b, c = self.SEED_SHIFTS
        halves = []
        for _ in range(2):
            state ^= state >> a
            state ^= state << b & _MASK
            state ^= state >> c
            halves.append(state * self.SEED_FACTOR & _MASK)
        self.low, self.high = halves

    def bits(self) -> int:
        """64 bits, unsigned."""
        drawn = self.low + self.high & _MASK
        mixed = self.low ^ self.high
        turn = lambda x, by: (x << by | x >> 64 - by) & _MASK
        self.low, self.high = turn(self.low, self.ROTATE) ^ mixed ^ (mixed << self.SHIFT & _MASK), turn(mixed, self.ROTATE_LAST)
        return drawn

    def signed(self) -> int:
        drawn = self.bits()
        return drawn - (1 << 64) if drawn >> 63 else drawn

    def below(self, n: int) -> int:
        """0 to n - 1: the low bits for a power of two, else the upper half scaled; 0 if there is no choice."""
        if n <= 0:
            return 0
        return self.bits() & n - 1 if n & -n == n else (self.bits() >> 32) * n >> 32

    def unit(self) -> float:
        """0 to 1, 1 excluded, in steps of 2**-53."""
        return (self.bits() >> 11) * 2.0**-53

    def sample(self, size: int, n: int) -> list[int]:
        """``size`` different ones of 0 to n - 1, all if there are no more, in the order in which they were first drawn."""
        chosen: dict[int, None] = {}
        while len(chosen) < min(size, n):
            chosen[self.below(n)] = None
        return list(chosen)
