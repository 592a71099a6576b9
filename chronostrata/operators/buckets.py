"""Which files of a bucketed table hold which keys, while the number of buckets grows with the table.

A bucket ``m:r`` holds the keys whose hash leaves r when divided by m. A table has a current modulus; it grows by a
factor when the buckets would hold more rows than wanted. Buckets of smaller moduli stay as they are until a change
touches them, and are split then, so growth never rewrites more than is touched. The directory has one entry a bucket,
and buckets have about the wanted number of rows, so its size is the table's divided by that.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rows that a task should write at most.
TASK_ROWS = 2_000_000


def grown(modulus: int, factor: int, rows: int, wanted: int) -> int:
    """The modulus with which buckets hold ``wanted`` rows or fewer on average."""
    while rows > modulus * wanted:
        modulus *= factor
    return modulus


def residue(hashed: Column, modulus: int) -> Column:
    return F.pmod(hashed, F.lit(modulus)).cast("int")


def split(key: str) -> tuple[int, int]:
    m, r = key.split(":")
    return int(m), int(r)


def covering(entries, residues: set[int], modulus: int) -> tuple[set[str], set[int]]:
    """The entries that hold any key of these residues, and all residues of which they hold keys."""
    held, reached = set(), set(residues)
    for m in {split(k)[0] for k in entries}:
        for r in {x % m for x in residues}:
            if f"{m}:{r}" in entries:
                held.add(f"{m}:{r}")
                reached.update(range(r, modulus, m))
    return held, reached


def spread(hashed: Column, rows: int, buckets: int) -> tuple[Column, int]:
    """A number that divides each bucket among several tasks where it has more rows than one should write, and the number
    of tasks in all."""
    parts = max(1, -(-rows // (max(1, buckets) * TASK_ROWS)))
    return F.pmod(F.shiftright(hashed, 40), F.lit(parts)).cast("int"), parts * max(1, buckets)
