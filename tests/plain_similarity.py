"""Plain versions of the scores, one pair at a time, by their definitions; the engine scores arrays of pairs."""

from collections.abc import Iterator


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit of one number for each character of `a`."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = (row + hit) | (row - hit)
    return len(a) - (row & full).bit_count()


def ratio(a: str, b: str) -> float:
    return 200.0 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def _sorted(a: str) -> str:
    return " ".join(sorted(a.split()))


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(_sorted(a), _sorted(b))


def _windows(n: int, m: int) -> Iterator[tuple[int, int]]:
    """Parts of a string of length n that one of length m <= n is held against: full windows, and shorter ones at both ends."""
    yield from ((i, i + m) for i in range(n - m + 1))
    yield from ((0, k) for k in range(1, m))
    yield from ((n - k, n) for k in range(1, m))


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string against a window of the longer one; at equal lengths, either way."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    best = max(ratio(a, b[i:j]) for i, j in _windows(len(b), len(a)))
    if len(a) == len(b) and best < 100:
        best = max(best, max(ratio(b, a[i:j]) for i, j in _windows(len(a), len(b))))
    return best


def scaled_partial_ratio(a: str, b: str) -> float:
    """The partial ratio times the share of the longer string that the shorter one covers."""
    short, long = sorted((len(a), len(b)))
    return partial_ratio(a, b) * (short / long) if long else 0.0


def _parts(a: str, b: str) -> tuple[str, str, str]:
    x, y = set(a.split()), set(b.split())
    return tuple(" ".join(sorted(s)) for s in (x & y, x - y, y - x))


def token_set_ratio(a: str, b: str) -> float:
    both, left, right = _parts(a, b)
    if not a.split() or not b.split():
        return 0.0
    if both and (not left or not right):
        return 100.0
    with_left, with_right = (f"{both} {x}" if both else x for x in (left, right))
    moved = len(left) + len(right) - 2 * lcs(left, right)
    best = 100.0 - 100.0 * moved / (len(with_left) + len(with_right))
    if both:
        best = max(best, *(100.0 - 100.0 * (len(w) - len(both)) / (len(both) + len(w)) for w in (with_left, with_right)))
    return best


def partial_token_ratio(a: str, b: str) -> float:
    both, left, right = _parts(a, b)
    if both:
        return 100.0
    return max(partial_ratio(_sorted(a), _sorted(b)), partial_ratio(left, right))


def weighted_ratio(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    apart = max(len(a), len(b)) / min(len(a), len(b))
    best = ratio(a, b)
    if apart < 1.5:
        return max(best, 0.95 * max(token_sort_ratio(a, b), token_set_ratio(a, b)))
    scale = 0.9 if apart < 8 else 0.6
    return max(best, scale * partial_ratio(a, b), 0.95 * scale * partial_token_ratio(a, b))


def lenient(a: str, b: str) -> float:
    """For names that were typed on purpose."""
    return max(weighted_ratio(a, b), token_sort_ratio(a, b), scaled_partial_ratio(a, b))


def strict(a: str, b: str) -> float:
    """For words of an address: a part of a name never scores like the name."""
    return max(token_sort_ratio(a, b), scaled_partial_ratio(a, b))

SCORERS = {"strict": strict, "lenient": lenient, "token_sort": token_sort_ratio, "partial": partial_ratio, "scaled_partial": scaled_partial_ratio, "weighted": weighted_ratio}
