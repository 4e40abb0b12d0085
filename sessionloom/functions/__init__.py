"""Column functions that Spark lacks, all composed of built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column, otherwise: float | Column = 0.0) -> Column:
    """part / whole, or ``otherwise`` where whole is zero or null."""
    other = otherwise if isinstance(otherwise, Column) else F.lit(otherwise)
    return F.when(whole != 0, part.cast("double") / whole).otherwise(other)


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def round_half_up(x: Column, digits: int = 0) -> Column:
    """Rounds halves towards plus infinity, as many report formats do."""
    scale = F.lit(10.0**digits)
    return F.floor(x * scale + 0.5) / scale


def dot(a: Column, b: Column) -> Column:
    """Inner product over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if a vector is all zero."""
    n = F.least(F.size(a), F.size(b))
    a, b = F.slice(a, 1, n), F.slice(b, 1, n)
    return ratio(dot(a, b), norm(a) * norm(b))


def normalized(a: Column) -> Column:
    """The vector scaled to length 1; zeros stay."""
    size = norm(a)
    return F.when(size > 0, F.transform(a, lambda x: x.cast("double") / size)).otherwise(a)


def squared_distance(a: Column, b: Column) -> Column:
    gaps = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x)


def softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    powers = F.transform(scores, lambda x: F.exp(x - top))
    total = F.aggregate(powers, F.lit(0.0), lambda s, x: s + x)
    return F.transform(powers, lambda x: x / total)


def argmax(scores: Column) -> Column:
    """Index from 0 of the first greatest element."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def entropy(probabilities: Column) -> Column:
    return F.aggregate(probabilities, F.lit(0.0), lambda s, p: s - F.when(p > 0, p * F.ln(p)).otherwise(0.0))


def count_loops(sequence: Column) -> Column:
    """How many runs of 2 to 5 elements are followed at once by the same run."""

    def loops(n: int) -> Column:
        starts = F.when(F.size(sequence) >= 2 * n, F.sequence(F.lit(1), F.size(sequence) - 2 * n + 1)).otherwise(F.array().cast("array<int>"))
        return F.size(F.filter(starts, lambda i: F.slice(sequence, i, n) == F.slice(sequence, i + n, n)))

    return loops(2) + loops(3) + loops(4) + loops(5)


def has_tail_loop(sequence: Column) -> Column:
    """Whether the end of a sequence of 8 or more is one run of 2 to 5 elements three times over."""

    def thrice(n: int) -> Column:
        a, b, c = (F.slice(sequence, F.size(sequence) - k * n + 1, n) for k in (3, 2, 1))
        return (F.size(sequence) >= 3 * n) & (a == b) & (b == c)

    repeated = thrice(2) | thrice(3) | thrice(4) | thrice(5)
    return F.when(F.size(sequence) >= 8, repeated).otherwise(F.lit(False))


def tail_repeats(sequence: Column, window: int, least: int) -> Column:
    """Whether the last ``window`` elements end in one run of 2 elements or more, ``least`` times over."""
    recent = F.slice(sequence, F.greatest(F.size(sequence) - window + 1, F.lit(1)), window)
    found = F.lit(False)
    for n in range(2, window // least + 1):
        suffix = F.slice(recent, F.size(recent) - n + 1, n)
        same = F.lit(True)
        for k in range(2, least + 1):
            same = same & (F.slice(recent, F.size(recent) - k * n + 1, n) == suffix)
        found = found | F.when(F.size(recent) >= n * least, same).otherwise(F.lit(False))
    return found
