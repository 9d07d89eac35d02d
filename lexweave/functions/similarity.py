"""Similarity scores of two strings, 0 to 100, after the definitions of the public RapidFuzz documentation.

All build on the longest common subsequence, computed bit-parallel: one pass over a string with the other as a bit vector.
"""

from __future__ import annotations

from collections.abc import Callable


def lcs_length(a: str, b: str) -> int:
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    open_ = full
    for c in b:
        hit = open_ & places.get(c, 0)
        open_ = (open_ + hit | open_ - hit) & full
    return (full & ~open_).bit_count()


def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 200.0 * lcs_length(a, b) / total if total else 100.0


def sort_tokens(s: str) -> str:
    return " ".join(sorted(s.split()))


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(sort_tokens(a), sort_tokens(b))


def qratio(a: str, b: str) -> float:
    return ratio(a, b) if a and b else 0.0


def token_set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    common, left, right = sorted(x & y), sorted(x - y), sorted(y - x)
    if common and (not left or not right):
        return 100.0
    both = " ".join(common)
    one, two = " ".join([both, *left] if both else left), " ".join([both, *right] if both else right)
    scores = [ratio(one, two)]
    if both:
        scores += [ratio(both, one), ratio(both, two)]
    return max(scores)


def token_ratio(a: str, b: str) -> float:
    return max(token_sort_ratio(a, b), token_set_ratio(a, b))


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter string with a window of the longer one, windows cut off at its ends included."""

    def best(short: str, long: str) -> float:
        m, n = len(short), len(long)
        cuts = [(max(0, i), min(n, i + m)) for i in range(-m + 1, n)]
        return max(ratio(short, long[x:y]) for x, y in cuts)

    if not a and not b:
        return 100.0
    if not a or not b:
        return 0.0
    if len(a) == len(b):
        return max(best(a, b), best(b, a))
    return best(a, b) if len(a) < len(b) else best(b, a)


def partial_token_sort_ratio(a: str, b: str) -> float:
    return partial_ratio(sort_tokens(a), sort_tokens(b))


def partial_token_set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    return 100.0 if x & y else partial_ratio(" ".join(sorted(x)), " ".join(sorted(y)))


def partial_token_ratio(a: str, b: str) -> float:
    return max(partial_token_sort_ratio(a, b), partial_token_set_ratio(a, b))


def wratio(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    n = max(len(a), len(b)) / min(len(a), len(b))
    if n < 1.5:
        return max(ratio(a, b), token_ratio(a, b) * 0.95)
    scale = 0.9 if n <= 8 else 0.6
    return max(ratio(a, b), partial_ratio(a, b) * scale, partial_token_ratio(a, b) * 0.95 * scale)


# Names under which scorers are known.
SCORERS: dict[str, Callable[[str, str], float]] = {
    "ratio": ratio, "token_sort_ratio": token_sort_ratio, "QRatio": qratio, "token_set_ratio": token_set_ratio, "token_ratio": token_ratio,
    "partial_ratio": partial_ratio, "partial_token_sort_ratio": partial_token_sort_ratio, "partial_token_set_ratio": partial_token_set_ratio,
    "partial_token_ratio": partial_token_ratio, "WRatio": wratio,
}


def scorer(name: str) -> Callable[[str, str], float]:
    if name not in SCORERS:
        raise ValueError(f"unknown scorer {name!r}; known: {', '.join(SCORERS)}")
    return SCORERS[name]
