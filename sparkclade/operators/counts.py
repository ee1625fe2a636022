"""Pairwise statistics: all are functions of joint state counts conf(i, j, a, b, cnt).

Sites are exchangeable, so equal site columns could be merged first; conf() joins
sites to themselves by site, which Spark can spread and split.  For many taxa use
conf_blocked(), or mismatches() where only those count: one-hot products of blocks of
taxa, summed over chunks of sites.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import groupby
from itertools import product as crossed

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkclade.storage import stored


def pairs(sites: DataFrame, diagonal: bool = False) -> DataFrame:
    """(i, j, site, a, b) for i < j (or i <= j) at sites that both have."""
    left = sites.select(F.col("taxon").alias("i"), "site", F.col("state").alias("a"))
    right = sites.select(F.col("taxon").alias("j"), "site", F.col("state").alias("b"))
    return left.join(right, "site").where("i <= j" if diagonal else "i < j")


def conf(sites: DataFrame, diagonal: bool = False) -> DataFrame:
    return pairs(sites, diagonal).groupBy("i", "j", "a", "b").agg(F.count("*").alias("cnt"))


def conf_blocked(sites: DataFrame, states: int, block: int = 512, chunk: int = 1024) -> DataFrame:
    """conf() without a row for each site and pair: blocks of taxa meet chunk by chunk of sites."""

    def product(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        flat = [x.transpose(1, 0, 2).reshape(-1, x.shape[2]) for x in (left, right)]
        return (flat[0] @ flat[1].T).reshape(left.shape[1], states, right.shape[1], states)

    def lists(tables: np.ndarray) -> tuple[np.ndarray, list[np.ndarray | int]]:
        """A pair's counts by a and b, in as few bits each as the largest needs, put together in words of 64."""
        most = int(tables.max())
        bits = next(n for n in (8, 16, 32, 64) if most >> n == 0)
        left, _, right, _ = tables.shape
        bytes_of = tables.astype(f"<u{bits // 8}").reshape(left, states, -1).view(f"V{states * bits // 8}")  # a state's counts of one b after another, moved as one
        cells = np.zeros((left, right, -(-states * states * bits // 64) * 8), dtype=np.uint8)
        cells[:, :, : states * states * bits // 8] = np.ascontiguousarray(bytes_of.transpose(0, 2, 1)).view(np.uint8)
        words = cells.view("<i8")
        return reduce(np.bitwise_or, np.moveaxis(words, 2, 0)) != 0, [bits, words]

    met = _meet(sites, block, chunk, product, lists, "bits int, words array<bigint>", lambda state: list(range(states)), wide=64)
    words = met.selectExpr("i", "js", f"cast(({states * states} * bits + 63) div 64 as int) AS each", "sequence(0, 64 - bits, bits) AS shifts", "if(bits = 64, -1L, shiftleft(1L, bits) - 1) AS mask", "words")
    word = words.select("i", "js", "each", "shifts", "mask", F.posexplode("words").alias("at", "word"))
    cells = word.selectExpr("i", "js[cast(at div each as int)] AS j", "at % each * size(shifts) AS first", "word", "mask", "shifts").select("i", "j", "first", "word", "mask", F.posexplode("shifts").alias("at", "shift"))
    some = cells.selectExpr("i", "j", "first + at AS cell", "shiftrightunsigned(word, shift) & mask AS cnt").where("cnt <> 0")
    return some.selectExpr("i", "j", f"cast(cell div {states} as int) AS a", f"cell % {states} AS b", "cnt")


def shared_sites(sites: DataFrame, block: int = 2048, chunk: int = 1024) -> DataFrame:
    """(i, j, n): valid_pairs() of conf(), by blocks."""
    met = _meet(sites, block, chunk, lambda left, right: (left[0] @ right[0].T)[None], lambda tables: (tables[0] != 0, [tables[0].astype(np.int64)]), "n array<bigint>", None)
    return met.select("i", "js", F.posexplode("n").alias("at", "n")).selectExpr("i", "js[at] AS j", "n")


def mismatches(sites: DataFrame, block: int = 2048, chunk: int = 1024) -> DataFrame:
    """(i, j, n, diff) for i < j: sites that both have, and those of them that differ.

    Blocks of taxa meet as one-hot products, so no row is made for a site and pair."""
    met = _meet(sites, block, chunk, _shared_and_different, lambda tables: (tables[0] != 0, [*tables.astype(np.int64)]), "n array<bigint>, diff array<bigint>", np.unique)
    return met.select("i", "js", "diff", F.posexplode("n").alias("at", "n")).selectExpr("i", "js[at] AS j", "n", "diff[at] AS diff")


def pair_scores(sites: DataFrame, score: Callable[[np.ndarray, np.ndarray], np.ndarray], block: int = 2048, chunk: int = 1024) -> DataFrame:
    """(i, j, s): score(n, diff) of mismatches(), worked out once for each n and diff that a pair of blocks has."""

    def lists(tables: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        n, diff = tables.astype(np.int64)
        width = int(n.max()) + 1
        key = n * width + diff
        if width <= 1024:
            seen = np.zeros(width * width, dtype=bool)
            seen[key] = True
            found, table = np.flatnonzero(seen), np.zeros(width * width)
        else:
            found, key = np.unique(key, return_inverse=True)
            table = np.zeros(len(found))
        some = found >= width  # else they share no site
        table[found[some] if width <= 1024 else np.flatnonzero(some)] = score(found[some] // width, found[some] % width)
        return n != 0, [table[key.reshape(n.shape)]]

    met = _meet(sites, block, chunk, _shared_and_different, lists, "s array<double>", np.unique)
    return met.select("i", "js", F.posexplode("s").alias("at", "s")).selectExpr("i", "js[at] AS j", "s")


def hamming_blocked(sites: DataFrame, block: int = 2048, chunk: int = 1024) -> DataFrame:
    """(i, j, h): hamming() of conf(), by blocks."""
    return pair_scores(sites, share, block, chunk).withColumnRenamed("s", "h")


def share(n: np.ndarray, diff: np.ndarray) -> np.ndarray:
    return diff / n


def _shared_and_different(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    side_by_side = lambda x: x.transpose(1, 0, 2).reshape(x.shape[1], -1)
    n = left.sum(axis=0) @ right.sum(axis=0).T
    return np.stack([n, n - side_by_side(left) @ side_by_side(right).T])


def _meet(sites: DataFrame, block: int, chunk: int, product: Callable, lists: Callable, values: str, kinds: Callable | None, wide: int | None = None) -> DataFrame:
    """(i, js, *values) for each taxon i and block of taxa: js are those above i that share a site with it, values has their lists.

    product(left, right) of two blocks' counts (state, taxon, site) in a chunk of sites gives tables (.., taxon, taxon), or (taxon, ..,
    taxon, ..), which are summed over chunks; lists(tables) tells which pairs share a site, and gives the values by taxa, or a number for all.
    kinds: the states to tell apart, None for none.  wide: js have so many at most, as what is made of a row is held at once.
    A pair of blocks is met from first to last in one task, and nothing is shuffled for a pair of taxa."""
    known = stored(sites.where("taxon IS NOT NULL AND site IS NOT NULL AND state IS NOT NULL").select(*(F.col(c).cast("bigint") for c in ("taxon", "site", "state"))))
    taxa = np.sort(known.select("taxon").distinct().toArrow()["taxon"].to_numpy())
    block = max(1, min(block, -(-len(taxa) // 8)))  # where taxa are few, blocks enough for some tasks
    count, numbered = -(-len(taxa) // block), known.sparkSession.sparkContext.broadcast(taxa)
    names = ["i", "js", *(v.split()[0] for v in values.split(", "))]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each block and chunk: taxon, site, state, and how often they are together."""
        for t in _gathered(batches, 1 << 20):
            taxon, site, state = (t[c].to_numpy() for c in ("taxon", "site", "state"))
            cells = np.stack([np.searchsorted(numbered.value, taxon), site, state])
            cells = cells[:, np.lexsort((state, site, cells[0], site // chunk, cells[0] // block))]
            first = np.flatnonzero(np.r_[True, (cells[:, 1:] != cells[:, :-1]).any(axis=0)])
            (at, site, state), times = cells[:, first], np.diff(np.r_[first, cells.shape[1]])
            blk, part = at // block, site // chunk
            cuts = np.flatnonzero(np.r_[True, (np.diff(blk) != 0) | (np.diff(part) != 0), True])
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                packed = [v[x:y].astype(np.min_scalar_type(v[x:y].max())) if v[x:y].min() >= 0 else v[x:y] for v in (at % block, site % chunk, state, times)]
                np.savez_compressed(file := io.BytesIO(), *packed)
                yield pa.RecordBatch.from_pydict({"blk": [int(blk[x])], "chunk": [int(part[x])], "cells": [file.getvalue()]})

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (b.slice(k, 1).to_pylist()[0] for b in batches for k in range(b.num_rows))
        for (lo, hi), pair in groupby(rows, lambda r: (r["lo"], r["hi"])):
            left, right = (numbered.value[k * block : (k + 1) * block] for k in (lo, hi))
            tables = None
            for _, met in groupby(pair, lambda r: r["chunk"]):
                cells = {lo: [], hi: []}
                for r in met:
                    cells[r["blk"]].append([v.astype(np.int64) for v in np.load(io.BytesIO(r["cells"])).values()])
                if all(cells.values()):
                    x, y = _counted([np.concatenate(c, axis=1) for c in (cells[lo], cells[hi])], (len(left), len(right)), chunk, kinds)
                    tables = product(x, y) if tables is None else tables.astype(np.float64) + product(x, y)
            if tables is not None:
                yield from listed(left, right, tables)

    def listed(left: np.ndarray, right: np.ndarray, tables: np.ndarray) -> Iterator[pa.RecordBatch]:
        (there, found), across = lists(tables), wide or block
        there, down = there & (left[:, None] < right), max(1, (1 << 17) // across)
        for y, x in crossed(range(0, len(left), down), range(0, len(right), across)):
            at = np.s_[y : y + down, x : x + across]
            n = there[at].sum(axis=1)
            if n.any():
                rows, some = np.flatnonzero(n), slice(None) if there[at].all() else there[at]
                columns = [pa.array(left[y + rows], pa.int64())]
                for v in (np.broadcast_to(right, there.shape), *found):
                    ends = np.r_[0, np.cumsum(n[rows])] * (np.size(v) // there.size)
                    columns.append(pa.ListArray.from_arrays(ends.astype(np.int32), v[at][some].ravel()) if np.ndim(v) else pa.array(np.full(len(rows), v, dtype=np.int32)))
                yield pa.RecordBatch.from_arrays(columns, names)

    pairs = F.explode(F.expr(f"transform(sequence(0, {max(count, 1) - 1}), o -> struct(least(o, blk) AS lo, greatest(o, blk) AS hi))")).alias("p")
    packed = known.mapInArrow(pack, "blk bigint, chunk bigint, cells binary").select("blk", "chunk", "cells", pairs).select("blk", "chunk", "cells", "p.lo", "p.hi")
    dealt = packed.repartition(max(1, min(count * (count + 1) // 2, 1024)), "lo", "hi").sortWithinPartitions("lo", "hi", "chunk")
    return dealt.mapInArrow(meet, f"i bigint, js array<bigint>, {values}")


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches together, up to so many rows or a batch more."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= rows:
            yield pa.Table.from_batches(held)
            held = []
    if sum(x.num_rows for x in held):
        yield pa.Table.from_batches(held)


def _counted(cells: list[np.ndarray], taxa: tuple[int, int], chunk: int, kinds: Callable | None) -> list[np.ndarray]:
    """Counts (state, taxon, site) of two blocks' cells (taxon, site, state, times), at sites that either has."""
    places = np.unique(np.concatenate([c[1] for c in cells]))
    states = np.asarray([0] if kinds is None else kinds(np.concatenate([c[2] for c in cells])))
    most = [c[3].max() for c in cells]
    small = float(most[0]) * float(most[1]) * chunk * len(states) ** 2 < 1 << 24  # sums that single precision holds
    out = []
    for (taxon, site, state, times), n in zip(cells, taxa, strict=True):
        kind = np.zeros(len(state), dtype=np.int64) if kinds is None else np.searchsorted(states, state)
        if kinds is not None and (states[np.minimum(kind, len(states) - 1)] != state).any():
            raise ValueError("a state is none of those to count")
        x = np.zeros((len(states), n, len(places)), dtype=np.float32 if small else np.float64)
        np.add.at(x.reshape(-1), (kind * n + taxon) * len(places) + np.searchsorted(places, site), times.astype(x.dtype))
        out.append(x)
    return out


def classes(sites: DataFrame) -> DataFrame:
    """(k): how many states the data have."""
    return sites.agg(F.count_distinct("state").alias("k"))


def site_prefix(sites: DataFrame, n: int) -> DataFrame:
    """The first n sites."""
    return sites.where(F.col("site") < n)


def valid_pairs(counts: DataFrame) -> DataFrame:
    return counts.groupBy("i", "j").agg(F.sum("cnt").alias("n"))


def hamming(counts: DataFrame) -> DataFrame:
    """(i, j, h): share of differing sites among those that both have."""
    return counts.groupBy("i", "j").agg((F.sum(F.when(F.col("a") != F.col("b"), F.col("cnt")).otherwise(0)) / F.sum("cnt")).alias("h"))


def base_frequencies(sites: DataFrame, states: int = 4) -> DataFrame:
    """(taxon, n, c0..): marginal counts of each taxon, not restricted to jointly valid sites."""
    cols = [F.sum((F.col("state") == s).cast("long")).alias(f"c{s}") for s in range(states)]
    return sites.where(F.col("state") < states).groupBy("taxon").agg(F.count("*").alias("n"), *cols)


def pair_frequencies(sites: DataFrame) -> DataFrame:
    """(i, j, g0..g3): base frequencies of each pair."""
    f = base_frequencies(sites)
    x = f.select(F.col("taxon").alias("i"), F.col("n").alias("ni"), *(F.col(f"c{s}").alias(f"x{s}") for s in range(4)))
    y = f.select(F.col("taxon").alias("j"), F.col("n").alias("nj"), *(F.col(f"c{s}").alias(f"y{s}") for s in range(4)))
    return x.join(y, F.col("i") < F.col("j")).select("i", "j", *((F.col(f"x{s}") + F.col(f"y{s}")).cast("double").__truediv__(F.col("ni") + F.col("nj")).alias(f"g{s}") for s in range(4)))


def transition_fractions(counts: DataFrame) -> DataFrame:
    """(i, j, p1, p2, h): shares of A-G, of C-T and of all differences among jointly valid sites."""
    share = lambda cond: F.sum(F.when(cond, F.col("cnt")).otherwise(0)) / F.sum("cnt")
    a, b = F.col("a"), F.col("b")
    both = lambda x, y: ((a == x) & (b == y)) | ((a == y) & (b == x))
    return counts.where((a < 4) & (b < 4)).groupBy("i", "j").agg(share(both(0, 2)).alias("p1"), share(both(1, 3)).alias("p2"), share(a != b).alias("h"))


def site_patterns(sites: DataFrame) -> DataFrame:
    """(pattern, cnt): how many sites have which states in order of taxa."""
    columns = sites.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("taxon", "state"))).alias("s"))
    return columns.select(F.array_join(F.transform("s", lambda x: x["state"].cast("string")), ",").alias("pattern")).groupBy("pattern").agg(F.count("*").alias("cnt"))
