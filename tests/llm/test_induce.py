"""Induced sorting against plain sorting of suffixes."""

import random

import pytest

from casewright.llm import induce, substrings


def plain(parts, cap):
    """The text of symbols, its suffixes in order, and common prefixes of neighbours up to cap."""
    text = bytes(1 if c == 255 else c + 2 for c in b"\xff".join(parts) + b"\xff") + b"\0"
    order = sorted(range(len(text)), key=lambda i: text[i:])
    return text, order


def common(text, a, b, cap):
    k = 0
    while k < cap and max(a, b) + k < len(text) and text[a + k] == text[b + k]:
        k += 1
    return k


@pytest.mark.parametrize("letters", [b"ab", b"abc", b"a", bytes(range(65, 90))])
def test_suffixes_are_in_order_with_their_common_prefixes(letters):
    rng = random.Random(len(letters))
    for trial in range(60):
        parts = [bytes(rng.choice(letters) for _ in range(rng.randrange(1, 40))) for _ in range(rng.randrange(1, 6))]
        parts = parts * 2 if trial % 3 == 0 else parts
        parts += [b"a" * rng.randrange(1, 60)] if trial % 5 == 0 else []
        for cap in (4, 10, 30, 200):
            text, want = plain(parts, cap)
            order, lcp = (x.tolist() for x in induce.suffixes(parts, cap))
            assert sorted(order) == sorted(want)
            assert [text[i : i + cap] for i in order] == [text[i : i + cap] for i in want]
            assert lcp[1:] == [common(text, a, b, cap) for a, b in zip(order, order[1:])]


def test_repeated_runs_equal_a_count_of_all_strings():
    rng = random.Random(9)
    for _ in range(80):
        base = bytes(rng.choice(b"xyz ") for _ in range(90))
        parts = []
        for _ in range(rng.randrange(1, 9)):
            lo = rng.randrange(60)
            parts.append(base[lo : lo + rng.randrange(5, 60)] + bytes(rng.choice(b"xyz") for _ in range(rng.randrange(12))))
        length = rng.choice((5, 12, 20))
        seen = {}
        for i, x in enumerate(parts):
            for k in range(len(x) - length + 1):
                seen.setdefault(x[k : k + length], []).append((i, k))
        want = {p for v in seen.values() if len(v) > 1 for p in v}
        got = {(c, k) for c, lo, hi in zip(*(x.tolist() for x in substrings.repeated_runs(parts, length))) for k in range(lo, hi + 1)}
        assert got == want
