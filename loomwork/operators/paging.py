"""Rows by their place in an order, without sorting a table: counts of ranges of the keys find a place.

Only keys are read to find one: each round counts the rows of BUCKETS ranges of a key's values, cut at rows drawn by
hash, and goes on in the range that holds the place, until FEW rows or one value are left; then the next key decides. What is sorted is FEW keys at
most, and a page is the first rows of a scan that begins at its own first key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

#: Ranges of a round, and rows that are few enough to sort.
BUCKETS, FEW = 64, 10_000

#: Columns and whether each goes down; together they tell all rows apart, or ties come in any order.
Order = list[tuple[str, bool]]


def _sorted(order: Order) -> list[Column]:
    return [F.desc_nulls_last(name) if down else F.asc_nulls_first(name) for name, down in order]


def key_at(rows: DataFrame, order: Order, place: int) -> Row | None:
    """The order's columns of the row at a place (from 0), null where there is none."""
    some = rows.select(*[name for name, _ in order])
    n, left = some.count(), place
    if not 0 <= place < n:
        return None
    names = [name for name, _ in order]
    for name, down in order:
        c = F.col(name)
        while n > FEW:
            low, high, nulls = some.agg(F.min(c), F.max(c), F.count_if(c.isNull())).first()
            if nulls == n or (low == high and not nulls):
                break
            # rows drawn by hash cut the values into ranges; null comes before them all
            drawn = some.where(c < high).orderBy(F.xxhash64(*names), *names).limit(BUCKETS - 1).select(name).collect() if low != high else []
            cuts = sorted({r[0] for r in drawn})
            range_of = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda m: m < c)) if cuts else F.lit(0)
            bucket = F.when(c.isNull(), -1).otherwise(range_of)
            for b, held in sorted(some.groupBy(bucket.alias("b")).count().collect(), reverse=down):  # BUCKETS rows at most
                if left < held:
                    some, n = some.where(bucket == b), held
                    break
                left -= held
        if n <= FEW:
            return some.orderBy(*_sorted(order)).offset(left).limit(1).first()
    return some.first()  # equal in all columns


def _from(order: Order, key: Row, own: bool) -> Column:
    """Whether a row stands at the key or after it, or only after it."""
    same, out = F.lit(True), F.lit(False)
    for name, down in order:
        c, v = F.col(name), key[name]
        if v is None:
            after = F.lit(False) if down else c.isNotNull()
        else:
            after = (c < v) | c.isNull() if down else c > v
        out, same = out | (same & F.coalesce(after, F.lit(False))), same & c.eqNullSafe(F.lit(v))
    return out | same if own else out


def _prunes(order: Order, key: Row) -> Column:
    """What the first key alone says of rows from the key on: a filter that reaches the scan."""
    name, down = order[0]
    if key[name] is None:
        return F.col(name).isNull() if down else F.lit(True)
    return (F.col(name) <= key[name]) | F.col(name).isNull() if down else F.col(name) >= key[name]


def page_of(rows: DataFrame, order: Order, number: int, size: int) -> tuple[DataFrame, int]:
    """(rows of a page, its number): a page past the end becomes the last one, one below 1 the first."""
    last = max(1, -(-rows.count() // size))
    number = min(max(1, number), last)
    if number == 1:
        return rows.orderBy(*_sorted(order)).limit(size), number
    key = key_at(rows, order, (number - 1) * size)
    return rows.where(_prunes(order, key) & _from(order, key, own=True)).orderBy(*_sorted(order)).limit(size), number


#: The column that hashed() adds.
HASH = "_hash"


def hashed(rows: DataFrame, seed: int) -> DataFrame:
    """rows with a seeded hash of each: the key of a shuffle that any rerun repeats."""
    return rows.withColumn(HASH, F.xxhash64(F.lit(seed), *[F.col(c) for c in rows.columns]))


#: Digits of 12 bits that a hash has for counts, the first of them signed.
DIGITS = (52, 40, 28, 16, 4)


def hash_at(rows: DataFrame, places: list[int]) -> list[int | None]:
    """The hashes at places (from 0) in their order, null where there is none; all places are found in the same passes.

    A pass counts the rows by the next 12 bits, in the ranges that still hold a place: 4096 counts a place at most. Hashes
    are spread evenly, so a range is FEW rows after a pass or two.
    """
    c = F.col(HASH)
    found: dict[int, int | None] = {}
    open_ = {place: (-(1 << 63), (1 << 63) - 1, place) for place in places}  # the range of a place, and what is left in it
    for shift in DIGITS:
        ranges = sorted({(low, high) for low, high, _ in open_.values()})
        if not ranges:
            break
        held = reduce(lambda a, b: a | b, [c.between(low, high) for low, high in ranges])
        counts = sorted(map(tuple, rows.where(held).groupBy(F.shiftright(c, shift).alias("d")).count().collect()))
        small: dict[int, tuple[int, int, int]] = {}
        for place, (low, high, left) in list(open_.items()):
            del open_[place]
            found[place] = None
            for d, n in counts:
                if not low <= d << shift <= high:
                    continue
                if left < n:
                    into = small if n <= FEW else open_
                    into[place] = (d << shift, (d + 1 << shift) - 1, left)
                    break
                left -= n
        if small:
            some = sorted({(low, high) for low, high, _ in small.values()})
            near = reduce(lambda a, b: a | b, [c.between(low, high) for low, high in some])
            hashes = sorted(r[0] for r in rows.where(near).select(HASH).collect())  # FEW rows a place at most
            for place, (low, high, left) in small.items():
                found[place] = [h for h in hashes if low <= h <= high][left]
    for place, (low, high, left) in open_.items():  # more than FEW rows within 4 bits: counts of single hashes
        for h, n in sorted(map(tuple, rows.where(c.between(low, high)).groupBy(HASH).count().collect())):
            if left < n:
                found[place] = h
                break
            left -= n
    return [found[p] if p >= 0 else None for p in places]


def lowest(rows: DataFrame, n: int) -> DataFrame:
    """Exactly the n rows of hashed() whose hash is lowest, all if they are fewer; of rows that tie at its end as many as fit."""
    if n <= 0:
        return rows.limit(0)
    key = hash_at(rows, [n - 1])[0]
    if key is None:
        return rows
    c = F.col(HASH)
    before = rows.where(c < key)
    left, same = n - before.count(), rows.where(c == key)
    if left == same.count():
        return rows.where(c <= key)  # one scan, no limit
    return before.unionByName(same.limit(left))


def parts(rows: DataFrame, shares: list[float]) -> list[DataFrame]:
    """hashed() rows in runs of their hash, each with floor(its share of all rows) of them, but the last has the rest.

    Rows that tie stay in one part, so then sizes are off by the ties.
    """
    n, upto = rows.count(), 0
    ends = []
    for share in shares[:-1]:
        upto += int(n * share)
        ends.append(upto)
    c, out, low = F.col(HASH), [], None
    within = lambda low, high: (F.lit(True) if low is None else c >= low) & (F.lit(True) if high is None else c < high)
    for key in hash_at(rows, ends):
        if key is None:  # nothing is left for the later parts
            key = (1 << 63) - 1
            out.append(rows.where(within(low, None)))
            rows, low = rows.limit(0), key
            continue
        out.append(rows.where(within(low, key)))
        low = key
    return [*out, rows.where(within(low, None))]
