"""String similarities and phonetic codes. Set measures are column expressions; edit measures and Metaphone are Arrow functions over batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import words


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, with a column of the table as the bits of one number (Hyyrö, 2004). Common ends belong to one."""
    ends, most = 0, min(len(a), len(b))
    while ends < most and a[ends] == b[ends]:
        ends += 1
    a, b, most = a[ends:], b[ends:], most - ends
    tail = 0
    while tail < most and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    if tail == most:
        return ends + tail
    a, b, ends = a[: len(a) - tail], b[: len(b) - tail], ends + tail
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & at.get(c, 0)
        v = (v + u | v - u) & full
    return ends + len(a) - v.bit_count()


def ratio(a: str, b: str) -> float:
    """2 LCS / (both lengths); 1 for two empty strings."""
    return 2.0 * lcs_length(a, b) / (len(a) + len(b)) if a or b else 1.0


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """The best ratio among the common words, and these with each side's others; 0 if a side has no word."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = sorted(x & y), sorted(x - y), sorted(y - x)
    if both and (not left or not right):
        return 1.0
    common, one, two = " ".join(both), " ".join(both + left), " ".join(both + right)
    out = ratio(one, two)
    if both:  # the common words begin either side
        out = max(out, *(2.0 * len(common) / (len(common) + len(x)) for x in (one, two)))
    return out


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string with any stretch of the longer one of that length, or cut off at either end; 0 if only one is empty."""
    if not a or not b:
        return 1.0 if a == b else 0.0
    if len(a) > len(b):
        a, b = b, a
    best, n = 0.0, len(a)
    if a in b:
        return 1.0
    letters = set(a)
    for i in range(1 - n, len(b)):
        piece = b[max(0, i) : i + n]
        # the best stretch ends, or at an edge begins, with a letter of the shorter string
        if (i + n <= len(b) and piece[-1] in letters) or (i + n > len(b) and piece[0] in letters):
            best = max(best, ratio(a, piece))
    if len(a) == len(b):
        for i in range(1 - n, len(a)):
            best = max(best, ratio(b, a[max(0, i) : i + n]))
    return best


def jaro(a: str, b: str) -> float:
    if not a or not b:
        return 1.0 if a == b else 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    free: dict[str, int] = {}  # of each letter, its places in b that are not used
    for j, c in enumerate(b):
        free[c] = free.get(c, 0) | 1 << j
    used, of_a = 0, []
    for i, c in enumerate(a):
        near = free.get(c, 0) & ((1 << i + reach + 1) - 1) >> max(0, i - reach) << max(0, i - reach)
        if near:
            first = near & -near
            free[c] ^= first
            used |= first
            of_a.append(c)
    m = len(of_a)
    if not m:
        return 0.0
    of_b = [c for j, c in enumerate(b) if used >> j & 1]
    t = sum(x != y for x, y in zip(of_a, of_b, strict=True)) // 2
    return (m / len(a) + m / len(b) + (m - t) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    """Jaro, raised by a tenth of what is missing for each of up to four common first letters, if it is over 0.7."""
    j = jaro(a, b)
    if j <= 0.7:
        return j
    same = 0
    while same < min(4, len(a), len(b)) and a[same] == b[same]:
        same += 1
    return j + 0.1 * same * (1 - j)


_FRONT, _VOWELS = set("eiy"), set("aeiou")


def metaphone(word: str) -> str:
    """The original Metaphone code (Philips, 1990), upper case; digits stay, and a word without code is its own."""
    w = "".join(c for c in word.lower() if c.isalnum())
    if w[:2] in ("kn", "gn", "pn", "ae", "wr"):
        w = w[1:]
    elif w[:1] == "x":
        w = "s" + w[1:]
    elif w[:2] == "wh":
        w = "w" + w[2:]
    out = []
    i = 0
    while i < len(w):
        c, prev, nxt, third = w[i], w[i - 1] if i else "", w[i + 1 : i + 2], w[i + 2 : i + 3]
        step, code = 1, ""
        if c == prev and c != "c":
            pass
        elif c in _VOWELS:
            code = c if i == 0 else ""
        elif c == "b":
            code = "" if prev == "m" and not nxt else "b"
        elif c == "c":
            if nxt == "i" and third == "a":
                code = "x"
            elif nxt == "h":
                code, step = ("k" if prev == "s" else "x"), 2
            elif nxt in _FRONT and nxt:
                code = "" if prev == "s" else "s"
            else:
                code = "k"
        elif c == "d":
            code, step = ("j", 2) if nxt == "g" and third in _FRONT and third else ("t", 1)
        elif c == "g":
            if nxt == "h" and third and third not in _VOWELS:
                pass
            elif nxt == "n" and (i + 2 == len(w) or w[i:] == "gned"):
                pass
            elif nxt in _FRONT and nxt and prev != "g":
                code = "j"
            else:
                code = "k"
                step = 2 if nxt == "h" else 1
        elif c == "h":
            code = "h" if nxt in _VOWELS and nxt and prev not in set("csptg") else ""
        elif c == "k":
            code = "" if prev == "c" else "k"
        elif c == "p":
            code, step = ("f", 2) if nxt == "h" else ("p", 1)
        elif c == "q":
            code = "k"
        elif c == "s":
            if nxt == "h":
                code, step = "x", 2
            elif nxt == "i" and third in ("o", "a") and third:
                code = "x"
            else:
                code = "s"
        elif c == "t":
            if nxt == "i" and third in ("o", "a") and third:
                code = "x"
            elif nxt == "h":
                code, step = "0", 2
            elif nxt == "c" and third == "h":
                pass
            else:
                code = "t"
        elif c == "v":
            code = "f"
        elif c in "wy":
            code = c if nxt in _VOWELS and nxt else ""
        elif c == "x":
            code = "ks"
        elif c == "z":
            code = "s"
        else:
            code = c
        out.append(code)
        i += step
    return "".join(out).upper() or word


def _pairwise(f: Callable[[str, str], float]):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict[tuple[str, str], float] = {}
        out = []
        for pair in zip(a.fillna(""), b.fillna(""), strict=True):
            if pair not in known:
                known[pair] = f(*pair)
            out.append(known[pair])
        return pd.Series(out, dtype="float64")

    return F.pandas_udf(run, T.DoubleType())


#: (a, b) columns to a double.
indel_ratio, token_sort, token_set, partial, jw = (_pairwise(f) for f in (ratio, token_sort_ratio, token_set_ratio, partial_ratio, jaro_winkler))
EDIT_MEASURES = {"lev_ratio": ratio, "jaro_winkler": jaro_winkler, "token_sort_ratio": token_sort_ratio, "partial_ratio": partial_ratio, "token_set_ratio": token_set_ratio}


#: Cells of a table that is combed at once, over all pairs: what a processor keeps near.
COMBED = 1 << 14


def combed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a, b: letters as numbers, a pair in each column, filled up with numbers that match nothing. For each place j of b, the s for which the common
    subsequence of a and b[l:r] is as many shorter than r - l as places j from l to r have s >= l (Tiskin, 2008: strands of a table are
    combed cell by cell; here those of a diagonal, and of all pairs, at once)."""
    m, n = len(a), len(b)
    kind = np.int16 if m + n < 1 << 15 else np.int32
    across, down = (np.repeat(np.arange(x, y, dtype=kind)[:, None], a.shape[1], 1) for x, y in ((0, m), (m, m + n)))
    back = np.ascontiguousarray(a[::-1])
    for d in range(m + n - 1):
        last = min(m - 1, d)
        k, j, size = m - 1 - last, d - last, last - max(0, d - n + 1) + 1
        h, v = across[k : k + size], down[j : j + size]
        turn = back[k : k + size] == b[j : j + size]
        turn |= h > v
        h_, v_ = np.where(turn, v, h), np.where(turn, h, v)
        h[:], v[:] = h_, v_
    return down.astype(np.int32) - m


def _grid(texts: list[str], fill: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points, a text in each column, and lengths."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    out = np.full((len(texts), int(size.max())), fill, np.int32)
    out[np.arange(out.shape[1]) < size[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.int32)
    return np.ascontiguousarray(out.T), size


def _windows(start: np.ndarray, w: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start: what `combed` gives for a of lengths w <= size, the lengths of b. The best ratio of a with a stretch of b of its length, or cut off at an end."""
    n, pairs = start.shape
    at, column = np.arange(n)[:, None], np.arange(pairs)
    end = np.full((n, pairs), n)  # where the strand that starts at a place ends, if in b
    j, p = np.nonzero((start >= 0) & (at < size))
    end[start[j, p], p] = j
    before = np.cumsum((start >= 0) & (at < size), 0)  # of b[: j + 1]
    r = at + 1
    best = np.where(r <= w, 2.0 * (r - before) / (w + r), 0.0).max(0)
    behind = np.cumsum((end < size)[::-1], 0)[::-1]
    left = size - at
    best = np.maximum(best, np.where((left > 0) & (left <= w), 2.0 * (left - behind) / (w + np.maximum(left, 1)), 0.0).max(0))
    # of b[l : l + w], by what changes from l to l + 1
    change = (start[np.minimum(at + w, n - 1), column] > at).astype(np.int32) - (end < at + w)
    lost = before[w - 1, column] + np.cumsum(change, 0)
    whole = np.where(at + 1 + w <= size, 2.0 * (w - lost) / (w + w), 0.0)
    return np.maximum(best, whole.max(0))


def ratios(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """ratio and partial_ratio of each pair, many pairs at once, those of like lengths together."""
    one, two = (np.array([f(x, y) for x, y in zip(a, b, strict=True)], float) for f in (lambda x, y: float(not (x or y)), lambda x, y: float(x == y)))
    short, long = ([f(x, y, key=len) if len(x) != len(y) else z for x, y, z in zip(a, b, c, strict=True)] for f, c in ((min, a), (max, b)))
    todo = sorted((i for i in range(len(a)) if short[i] and long[i] != short[i]), key=lambda i: (len(short[i]), len(long[i])))
    one[[i for i in range(len(a)) if a[i] == b[i]]] = 1.0
    k = 0
    while k < len(todo):
        some = todo[k : k + max(1, COMBED // len(short[todo[k]]))]
        k += len(some)
        (x, w), (y, size) = _grid([short[i] for i in some], -1), _grid([long[i] for i in some], -2)
        start = combed(x, y)
        common = size - ((start >= 0) & (np.arange(len(y))[:, None] < size)).sum(0)
        one[some] = 2.0 * common / (w + size)
        two[some] = _windows(start, w, size)
        same = np.flatnonzero(w == size)
        if len(same):
            back = _windows(combed(y[:, same], x[:, same]), w[same], w[same])
            some = np.array(some)[same]
            two[some] = np.maximum(two[some], back)
    return one, two


@F.pandas_udf(T.StructType([T.StructField(k, T.DoubleType()) for k in EDIT_MEASURES]))
def edit_measures(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """All edit measures of a pair in one crossing to Python; pairs that repeat are measured once."""
    pairs = list(zip(a.fillna(""), b.fillna(""), strict=True))
    place = {pair: i for i, pair in enumerate(dict.fromkeys(pairs))}
    lev, part = ratios([x for x, _ in place], [y for _, y in place])
    found = {k: [f(x, y) for x, y in place] for k, f in EDIT_MEASURES.items() if f not in (ratio, partial_ratio)} | {"lev_ratio": lev, "partial_ratio": part}
    own = [place[pair] for pair in pairs]
    return pd.DataFrame({k: np.asarray(found[k], float)[own] for k in EDIT_MEASURES})


@F.pandas_udf(T.StringType())
def metaphone_code(s: pd.Series) -> pd.Series:
    return s.map(lambda x: metaphone(x) if x else "", na_action="ignore")


def soundex_code(c: Column) -> Column:
    """Soundex of the letters; empty for a text without any, where the built-in function returns its input."""
    letters = F.regexp_replace(c, "[^A-Za-z]", "")
    return F.when(letters == "", "").otherwise(F.soundex(letters))


def safe_divide(a: Column, b: Column, fill: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(fill))


def token_set_size(a: Column) -> Column:
    return F.size(F.array_distinct(words(a)))


def token_jaccard(a: Column, b: Column) -> Column:
    x, y = words(a), words(b)
    return safe_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y)))


def token_overlap(a: Column, b: Column) -> Column:
    return safe_divide(F.size(F.array_intersect(words(a), words(b))), F.least(token_set_size(a), token_set_size(b)))


def padded_grams(c: Column, sizes: tuple[int, ...] = (2, 3)) -> Column:
    """All n-grams of each word with a blank at either end; a padded word shorter than n is itself one, the first time."""
    def of(w: Column, n: int) -> Column:
        p = F.concat(F.lit(" "), w, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(p) - (n - 1), F.lit(1))), lambda i: F.substr(p, i, F.lit(n)))

    return F.flatten(F.transform(words(c), lambda w: F.concat(*[of(w, n) for n in sizes])))


def gram_jaccard(a: Column, b: Column) -> Column:
    x, y = padded_grams(a), padded_grams(b)
    return safe_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y)))


def prefix_overlap(a: Column, b: Column) -> Column:
    """Length of the common beginning over the longer length; 0 if both are empty."""
    shorter = F.least(F.length(a), F.length(b))
    same = F.size(F.filter(F.sequence(F.lit(0), shorter), lambda i: (i > 0) & (F.substr(a, F.lit(1), i) == F.substr(b, F.lit(1), i))))
    return safe_divide(same, F.greatest(F.length(a), F.length(b)))


def length_diff(a: Column, b: Column) -> Column:
    return F.abs(F.length(a) - F.length(b)).cast("double")


def length_ratio(a: Column, b: Column) -> Column:
    return safe_divide(F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b)), 1.0)


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays of numbers; 0 if one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return safe_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def unicode_numbers(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?U)\d+"), F.lit(0)))


def prior_shift(p: Column, alpha: float) -> Column:
    """Odds times alpha."""
    return alpha * p / (alpha * p + 1 - p)


def finite(c: Column) -> Column:
    """NaN and infinite numbers as 0."""
    c = F.nanvl(c.cast("double"), F.lit(0.0))
    return F.when(c.isNull() | (F.abs(c) == float("inf")), 0.0).otherwise(c)
