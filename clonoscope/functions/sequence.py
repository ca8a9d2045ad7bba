"""Token functions on sequence columns: Column to Column, no Python in the tasks."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The amino-acid alphabet, and per residue hydropathy, charge and polarity (others 0).
ALPHABET = "ACDEFGHIKLMNPQRSTVWY"
HYDROPATHY = {"A": 1.8, "C": 2.5, "D": -3.5, "E": -3.5, "F": 2.8, "G": -0.4, "H": -3.2, "I": 4.5, "K": -3.9, "L": 3.8, "M": 1.9, "N": -3.5, "P": -1.6, "Q": -3.5, "R": -4.5, "S": -0.8, "T": -0.7, "V": 4.2, "W": -0.9, "Y": -1.3}
CHARGE = {"D": -1.0, "E": -1.0, "H": 1.0, "K": 1.0, "R": 1.0}
POLARITY = {"D": 1.0, "E": 1.0, "H": 1.0, "K": 1.0, "N": 1.0, "Q": 1.0, "R": 1.0, "S": 1.0, "T": 1.0, "Y": 1.0}


def none() -> Column:
    return F.array().cast("array<string>")


def vocabulary(spark: SparkSession, k: int) -> DataFrame:
    """All words of k amino acids."""
    letters = spark.createDataFrame([(a,) for a in ALPHABET], "kmer string")
    out = letters
    for _ in range(k - 1):
        out = out.crossJoin(letters.select(F.col("kmer").alias("next"))).select(F.concat("kmer", "next").alias("kmer"))
    return out


def starts(s: Column, width: int) -> Column:
    """1-based starts of the windows of `width` letters; null where there is none."""
    return F.when(F.length(s) >= width, F.sequence(F.lit(1), F.length(s) - width + 1))


def kmers(s: Column, k: int) -> Column:
    """Contiguous k-mers, none of a shorter sequence."""
    return F.coalesce(F.transform(starts(s, k), lambda i: F.substring(s, i, k)), none())


def gap_kmers(s: Column, k: int, at: int | None = None) -> Column:
    """Windows of k + 1 letters with a dot for the letter after the first `at` (half of k)."""
    at = k // 2 if at is None else at
    return F.coalesce(F.transform(starts(s, k + 1), lambda i: F.concat(F.substring(s, i, at), F.lit("."), F.substr(s, i + at + 1, F.lit(k - at)))), none())


def kmers_with_gap(s: Column, k: int) -> Column:
    """k-mers and, from four letters, those with one gap in the middle."""
    return F.concat(kmers(s, k), gap_kmers(s, k)) if k >= 4 else kmers(s, k)


def all_gap_kmers(s: Column, k: int) -> Column:
    """k-mers with one gap at each inner place."""
    return F.concat(*[gap_kmers(s, k, at) for at in range(1, k)])


def masks(lengths: tuple[int, ...] = (4, 5, 6), most_gaps: int = 3) -> list[tuple[bool, ...]]:
    """Windows whose ends are letters and whose inner places are letters or up to so many gaps."""
    return [
        tuple(i not in gaps for i in range(n))
        for n in lengths
        for g in range(most_gaps + 1)
        for gaps in combinations(range(1, n - 1), g)
    ]


def gapped_tokens(s: Column, lengths: tuple[int, ...] = (4, 5, 6), most_gaps: int = 3) -> Column:
    """Every mask at every place, dots for gaps."""

    def one(mask: tuple[bool, ...]) -> Column:
        return F.transform(starts(s, len(mask)), lambda i: F.concat(*[F.substring(s, i + j, 1) if keep else F.lit(".") for j, keep in enumerate(mask)]))

    return F.flatten(F.array(*[F.coalesce(one(m), none()) for m in masks(lengths, most_gaps)]))


def mask_tokens(window: Column, lengths: tuple[int, ...] = (4, 5, 6), most_gaps: int = 3) -> Column:
    """The tokens of one whole window: each mask of its length once. gapped_tokens of a sequence are those of its
    windows of all lengths."""

    def one(mask: tuple[bool, ...]) -> Column:
        return F.concat(*[F.substring(window, j + 1, 1) if keep else F.lit(".") for j, keep in enumerate(mask)])

    out = F.array().cast("array<string>")
    for n in lengths:
        out = F.when(F.length(window) == n, F.array(*[one(m) for m in masks((n,), most_gaps)])).otherwise(out)
    return out


def hashed_embedding(s: Column, dims: int = 32, k: int = 3) -> Column:
    """A sequence as a vector of length 1 (zeros for sequences without a k-mer): each k-mer adds one with the sign of its
    MD5 to the dimension that the MD5 names. It stands in wherever an embedding is taken."""
    number = lambda g: F.conv(F.substring(F.md5(g.cast("binary")), 1, 8), 16, 10).cast("long")
    marks = F.transform(kmers(s, k), number)

    def of(marks: Column) -> Column:
        sign = lambda x: F.when(F.floor(x / dims) % 2 == 0, 1.0).otherwise(-1.0)
        at = lambda d: F.aggregate(marks, F.lit(0.0), lambda a, x: a + F.when(x % dims == d, sign(x)).otherwise(0.0))
        return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), at)

    def unit(v: Column) -> Column:
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
        return F.transform(v, lambda x: x / F.when(norm == 0, 1.0).otherwise(norm))

    bound = lambda value, then: F.get(F.transform(F.array(value), then), F.lit(0))  # noqa: E731  computed once
    return bound(bound(marks, of), unit)


def spaced(s: Column) -> Column:
    """A space between letters."""
    return F.array_join(F.split(s, ""), " ")


def letter_counts(s: Column) -> Column:
    """How often each letter of the alphabet occurs, in its order."""
    return F.array(*[(F.length(s) - F.length(F.replace(s, F.lit(a), F.lit("")))).cast("double") for a in ALPHABET])


def mean_property(s: Column, values: dict[str, float]) -> Column:
    """Mean of a residue property over all letters, 0 for letters without one; null of an empty sequence."""
    total = sum(((F.length(s) - F.length(F.replace(s, F.lit(a), F.lit("")))) * F.lit(v) for a, v in values.items()), F.lit(0.0))
    return total / F.nullif(F.length(s), F.lit(0))
