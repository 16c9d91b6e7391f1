"""Sets of cases and sequences of activities as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of two sets; of two empty sets 0."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def contains_run(sequence: Column, run: Column) -> Column:
    """Whether ``run`` stands in ``sequence`` without gaps, element by element; an empty run always does."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(sequence) - F.size(run) + 1, F.lit(1)))
    found = F.exists(starts, lambda i: F.slice(sequence, i, F.size(run)) == run)
    return F.when(F.size(run) == 0, F.lit(True)).otherwise((F.size(run) <= F.size(sequence)) & found)


def contains_joined(sequence: Column, run: Column, mark: str = "#") -> Column:
    """The same by joined names, as a substring: faster, but a name that ends like the first one, begins like
    the last or holds the mark matches too."""
    return F.array_join(sequence, mark).contains(F.array_join(run, mark))


def project(path: Column) -> Column:
    """Activities along a path of segments (structs with e1 and e2): the first one's start, then each one's end."""
    return F.concat(F.array(F.get(path, F.lit(0))["e1"]), F.transform(path, lambda x: x["e2"]))


def is_proper_prefix(a: Column, b: Column) -> Column:
    return (F.size(a) < F.size(b)) & (F.slice(b, 1, F.size(a)) == a)
