"""Sharding: a Feistel permutation with cycle walking over global row numbers.

Native: DataFrame and SQL functions only.

Every row gets a global number: rows are ordered by bucket (a hash of what they
are told apart by), and within a bucket by their values; equal rows are counted
before anything is shuffled, so a repeated row or a hot key is one entry however
often it occurs.  A Feistel network over Z_a x Z_b, with a*b >= N, maps the
numbers onto a * b; cycle walking brings the few that leave [0, N) back.  Shard
and slot are remainder and quotient of the result, so shards differ by one row at
most (law `rows`), and the place of any number can be computed without a table.

Null ids and texts are values like others (a null text has size 1 and CRC 0);
repeated (tied) rows get places of their own; an empty table gives an empty result;
columns other than the keys are not read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct rows of a bucket of the global numbering, about; a bucket is sorted by one task.
BUCKET_ROWS = 250_000
ROUNDS = 6
#: Widths that are tried for the grid: the excess of the best is about its width over this.
WIDTHS = 1 << 20
#: Copies of a row that are put out by one task; more are dealt out in parts.
COPIES = 65_536


def domain(n: int) -> tuple[int, int]:
    """Sides a, b of the grid with the least a * b >= n, for a from the root of n on."""
    if not n:
        return 1, 1
    root = max(1, math.isqrt(n - 1) + 1)
    widths = np.arange(root, root + min(root, WIDTHS), dtype=np.int64)
    a = int(widths[np.argmin(-n % widths)])
    return a, -(-n // a)


def permuted_sql(x: str, n: int, seed: int) -> str:
    """SQL for the place of row number x in a seeded permutation of [0, n)."""
    a, b = domain(n)

    def network(v: str) -> str:
        pair = f"named_struct('l', {v} % {a}L, 'r', {v} div {a}L)"
        step = (
            f"if(k % 2 = 0, named_struct('l', (s.l + pmod(xxhash64(s.r, k, {seed}L), {a}L)) % {a}L, 'r', s.r), "
            f"named_struct('l', s.l, 'r', (s.r + pmod(xxhash64(s.l, k, {seed}L), {b}L)) % {b}L))"
        )
        return f"aggregate(sequence(0, {ROUNDS - 1}), {pair}, (s, k) -> {step}, s -> s.l + s.r * {a}L)"

    # A walk passes each of the a * b - n values outside once at most; the grid is chosen so that they are a handful.
    outside = a * b - n
    if not outside:
        return network(x)
    return f"aggregate(sequence(0, {outside}), named_struct('v', {x}, 'go', true), (w, i) -> if(w.go, {_walk(network('w.v'), n)}, w), w -> w.v)"


def _walk(value: str, n: int) -> str:
    return f"transform(array({value}), y -> named_struct('v', y, 'go', y >= {n}L))[0]"


def numbered(df: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """df's rows, as their keys only (in0, in1 and so on), with a gapless global number `row_no` from 0.

    The number depends on the rows alone, not on how they are partitioned."""
    names = [f"in{i}" for i in range(len(keys))]
    rows = df.select(*(F.col(k).alias(name) for k, name in zip(keys, names, strict=True)))
    bucket = F.pmod(F.xxhash64(*names), F.lit(buckets)).cast("int")
    counted = rows.groupBy(bucket.alias("bucket"), *names).agg(F.count("*").alias("n"))
    start = ", ".join(f"{k} asc nulls first" for k in names)
    before = "coalesce(sum({0}) over ({1} rows between unbounded preceding and 1 preceding), 0L)"
    # One row for each bucket, so at most `buckets` rows meet in the window and in the broadcast.
    offset = counted.groupBy("bucket").agg(F.sum("n").alias("all")).select("bucket", F.expr(before.format("all", "order by bucket")).alias("offset"))
    within = counted.withColumn("before", F.expr(before.format("n", f"partition by bucket order by {start}")))
    first = within.join(F.broadcast(offset), "bucket").select(*names, "n", F.expr("offset + before").alias("first"))
    few = first.where(F.col("n") <= COPIES).select(*names, "first", F.explode(F.expr("sequence(0L, n - 1)")).alias("copy"))
    # A row that occurs very often is dealt out in parts.
    parts = first.where(F.col("n") > COPIES).select(*names, "first", "n", F.explode(F.expr(f"sequence(0L, n - 1, {COPIES}L)")).alias("part")).repartition("first", "part")
    many = parts.select(*names, "first", F.explode(F.expr(f"sequence(part, least(n, part + {COPIES}) - 1)")).alias("copy"))
    return few.unionByName(many).select(*names, F.expr("first + copy").alias("row_no"))


def shard(df: DataFrame, keys: list[str], shards: int, seed: int = 20240229) -> DataFrame:
    """The key columns of df with `row_no`, `shard` and `slot`: shuffled, and equal to within one row.

    Keys may have any names but these three."""
    n = df.count()
    if not n:
        return df.select(*keys).selectExpr("*", "0L row_no", "0 shard", "0L slot")
    place = F.expr(permuted_sql("row_no", n, seed))
    placed = numbered(df, keys, max(16, n // BUCKET_ROWS)).withColumn("place", place)
    names = [F.col(f"in{i}").alias(k) for i, k in enumerate(keys)]
    return placed.select(*names, "row_no", F.expr(f"cast(place % {shards} as int)").alias("shard"), F.expr(f"place div {shards}").alias("slot"))
