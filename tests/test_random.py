"""The generator against its published steps, written out for the first draws, and its draws' ranges."""

from lodestar.functions.random import Xoroshiro128


def test_first_draws_by_hand():
    """Seed 1: 1 -> 1 ^ 1 << 25 -> 33554433 after each shift by hand, times the factor."""
    one = Xoroshiro128(1)
    state = 1 ^ 1 >> 12
    state ^= state << 25  # 33554433
    assert state == 33554433
    state ^= state >> 27  # 33554433 < 2**27, so unchanged
    low = state * 2685821657736338717 % 2**64
    state ^= state >> 12  # 33554433 ^ 8192 = 33562625
    assert state == 33562625
    state = (state ^ state << 25) % 2**64
    state ^= state >> 27
    high = state * 2685821657736338717 % 2**64
    assert (one.low, one.high) == (low, high)
    assert one.bits() == (low + high) % 2**64
    mixed = low ^ high
    assert one.high == (mixed << 36 | mixed >> 28) % 2**64
    assert one.low == ((low << 55 | low >> 9) ^ mixed ^ mixed << 14) % 2**64


def test_ranges():
    rng = Xoroshiro128(0)
    assert Xoroshiro128(0).bits() == Xoroshiro128(4101842887655102017).bits()
    assert rng.below(0) == rng.below(-3) == 0
    for n in (1, 2, 7, 64, 1000):
        drawn = [rng.below(n) for _ in range(400)]
        assert min(drawn) >= 0 and max(drawn) < n and (n < 8) <= (set(drawn) == set(range(n)))
    assert all(0 <= rng.unit() < 1 for _ in range(200))
    assert all(-(2**63) <= rng.signed() < 2**63 for _ in range(50))
    assert Xoroshiro128(-5).bits() == Xoroshiro128(2**64 - 5).bits()


def test_sample_without_replacement():
    rng = Xoroshiro128(9)
    drawn = rng.sample(50, 60)
    assert len(set(drawn)) == 50 and set(drawn) <= set(range(60))
    assert sorted(rng.sample(10, 4)) == [0, 1, 2, 3] and rng.sample(3, 0) == []
    again, first = Xoroshiro128(9), []
    while len(first) < 50:
        x = again.below(60)
        first += [x] * (x not in first)
    assert drawn == first
