"""Embedding near-dedup: cross-polytope hashing after fast Hadamard rotations.

In each of several tables a vector is rotated pseudo-randomly (signs, Hadamard
transform, twice) and hashed to the signed axis that it is closest to, two
rotations making one bucket; it is also put in the buckets of the next-closest axes
(multiprobe).  Vectors that meet in a bucket are compared by cosine in double
precision, block against block, so a bucket of any size is worked on by many tasks
with bounded memory, and what comes out is a number of links and a spanning forest
for each block pair, never all pairs.  A pair that meets in several tables counts in
the first.

Vectors that are equal are collapsed before anything is compared.  Vectors that are
null or zero, or hold null or non-finite components, and vectors with a null label
or null id, link with nothing; an empty table gives an empty result.  A row's id is
taken as its identity: rows that share one count as one vector, the smallest of them.
Ties don't matter, as every pair that meets is compared; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkclade.llm.common import components, written

COSINE = 0.93
TABLES = 10
#: Buckets that a vector is put in for each table: the closest, and next-closest axes.
PROBES = 3
#: Vectors in a block; two blocks are compared at a time, so a bucket's vector is sent once
#: for each BLOCK vectors of the bucket.
BLOCK = 2048


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row; the width is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def axes(x: np.ndarray, seed: int, best: int) -> tuple[np.ndarray, np.ndarray]:
    """The `best` closest signed axes of each rotated row, and how close they are."""
    width = 1 << max(1, (x.shape[1] - 1).bit_length())
    y = np.zeros((len(x), width))
    y[:, : x.shape[1]] = x
    rng = np.random.default_rng(seed)
    for _ in range(3):
        y = hadamard(y * rng.choice([-1.0, 1.0], size=width))
    top = np.argpartition(-np.abs(y), best, axis=1)[:, :best] if best < width else np.tile(np.arange(width), (len(x), 1))
    size = np.take_along_axis(np.abs(y), top, axis=1)
    order = np.argsort(-size, axis=1, kind="stable")
    top, size = np.take_along_axis(top, order, axis=1), np.take_along_axis(size, order, axis=1)
    return top * 2 + (np.take_along_axis(y, top, axis=1) < 0), size


def codes(x: np.ndarray, tables: int = TABLES, probes: int = PROBES) -> np.ndarray:
    """bucket[row, table, probe]: the pair of closest axes of two rotations, then the pairs
    that differ in the axis whose runner-up is nearest."""
    out = np.zeros((len(x), tables, probes), dtype=np.int32)
    for t in range(tables):
        (a, a_size), (b, b_size) = (axes(x, 1000 * t + k, probes + 1) for k in (1, 2))
        options = [(i, j) for i in range(min(probes, a.shape[1])) for j in range(min(probes, b.shape[1])) if i == 0 or j == 0]
        loss = np.stack([(a_size[:, 0] - a_size[:, i]) + (b_size[:, 0] - b_size[:, j]) for i, j in options], axis=1)
        code = np.stack([a[:, i] * 65536 + b[:, j] for i, j in options], axis=1)
        pick = np.argsort(loss, axis=1, kind="stable")[:, :probes]
        out[:, t] = np.take_along_axis(code, pick, axis=1)
    return out


def unit(flat: np.ndarray, width: int) -> np.ndarray:
    x = flat.reshape(-1, width).astype(np.float64)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what the pairs (a, b) of numbers below n join, one for each number but the smallest of its component."""
    root = np.arange(n)
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low != high
        if not apart.any():
            break
        a, b = a[apart], b[apart]
        np.minimum.at(root, high[apart], low[apart])
        while (root[root] != root).any():
            root = root[root]
    joined = np.flatnonzero(root != np.arange(n))
    return joined, root[joined]


#: Rows of the small groups that are compared at once, and most rows of such a group.
AT_ONCE, FEW = 50_000, 16
#: Rows of a block that are compared with another block at once.
ROWS = 512


def _near(x: np.ndarray, start: np.ndarray, size: np.ndarray, left: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of x with at least that cosine, in each group (start, size): within it
    where all rows are on the left side (left = size), else from the left side to the right."""
    found_a, found_b = [], []
    within = left == size
    for d in range(2, FEW + 1):
        first = start[within & (size == d)]
        i, j = np.triu_indices(d, 1)
        step = max(1, AT_ONCE // len(i))
        for at in range(0, len(first), step):
            a, b = ((first[at : at + step, None] + k).ravel() for k in (i, j))
            near = np.einsum("ij,ij->i", x[a], x[b]) >= cosine
            found_a.append(a[near])
            found_b.append(b[near])
    for g in np.flatnonzero((left > 0) & (~within | (size > FEW))).tolist():
        s, n, k = int(start[g]), int(size[g]), int(left[g])
        # Some rows at a time, as all products of two blocks are many.
        for at in range(0, k, ROWS):
            to = min(at + ROWS, k)
            after = at if within[g] else k
            a, b = np.nonzero(x[s + at : s + to] @ x[s + after : s + n].T >= cosine)
            a, b = a + at, b + after
            if within[g]:
                a, b = a[a < b], b[a < b]
            found_a.append(a + s)
            found_b.append(b + s)
    none = [np.zeros(0, dtype=np.int64)]
    return np.concatenate(found_a + none), np.concatenate(found_b + none)


def _first_meeting(a, b, code, table, bucket) -> np.ndarray:
    """Which pairs of rows share no bucket of an earlier table, and no lower one of this table.

    Tables are looked at in turn, each only for the pairs that have not met yet: near copies meet in the first."""
    first = np.ones(len(a), dtype=bool)
    for start in range(0, len(a), AT_ONCE):
        rest = np.arange(start, min(start + AT_ONCE, len(a)))
        for t in range(code.shape[1]):
            p, q = code[a[rest], t], code[b[rest], t]
            same, at = p[:, :, None] == q[:, None, :], table[a[rest]]
            lower = same & (p < bucket[a[rest], None])[:, :, None]
            met = np.where(at > t, same.any(axis=(1, 2)), lower.any(axis=(1, 2)))
            first[rest[met]] = False
            rest = rest[~met & (at > t)]
            if not len(rest):
                break
    return first


def compare(rows: pa.RecordBatch, cosine: float) -> pa.RecordBatch | None:
    """Links in whole groups of SENT rows, sorted by SORTED, all of one width, as counts and forest edges.

    `weight` of a row is how many ids have that very vector.  A pair counts in the first
    table, and there in the lowest bucket, that it shares."""
    column = {k: rows.column(k).to_numpy(zero_copy_only=False) for k in ("table", "bucket", "lo", "hi", "mine", "vec_id", "weight")}
    start = np.append(0, np.flatnonzero(changes(rows)) + 1)
    size = np.diff(np.append(start, rows.num_rows))
    left = np.add.reduceat((column["mine"] == column["lo"]).astype(np.int64), start)
    # Two blocks of which one is empty have nothing to compare.
    left[(left == size) & (column["lo"][start] != column["hi"][start])] = 0
    x = unit(rows.column("embedding").flatten().to_numpy(zero_copy_only=False), int(rows.column("width")[0].as_py()))
    a, b = _near(x, start, size, left, cosine)
    ids, weight = column["vec_id"], column["weight"]
    distinct = ids[a] != ids[b]
    a, b = a[distinct], b[distinct]
    code = rows.column("code").flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1, PROBES)
    first = _first_meeting(a, b, code, column["table"], column["bucket"])
    a, b = a[first], b[first]
    if not len(a):
        return None
    links = np.bincount(a, weights=weight[b], minlength=len(ids)) + np.bincount(b, weights=weight[a], minlength=len(ids))
    touched = np.flatnonzero(links)
    x, y = forest(a, b, len(ids))
    out = (np.append(ids[touched], ids[x]), np.append(ids[touched], ids[y]), np.append(links[touched].astype(np.int64), np.zeros(len(x), dtype=np.int64)))
    return pa.RecordBatch.from_arrays([pa.array(v) for v in out], names=["a", "b", "links"])


#: What names a group: two blocks of a bucket, or one; and the order of the rows.
GROUP = ["label", "width", "table", "bucket", "lo", "hi"]
SORTED = [*GROUP, "mine_last", "vec_id"]
SENT = [*GROUP, "mine", "vec_id", "weight", "embedding", "code"]


def changes(rows: pa.RecordBatch) -> np.ndarray:
    """Whether each row but the first is of another group than the one before."""
    out = np.zeros(max(rows.num_rows - 1, 0), dtype=bool)
    for name in GROUP:
        values = rows.column(name)
        out |= pc.not_equal(values[1:], values[:-1]).to_numpy(zero_copy_only=False)
    return out


def compare_sorted(batches, cosine: float):
    """compare() over batches of sorted rows, of which the last group is held until it is whole."""
    held: list[pa.RecordBatch] = []

    def done(whole: pa.RecordBatch):
        width = whole.column("width").to_numpy()
        cuts = [0, *(np.flatnonzero(width[1:] != width[:-1]) + 1).tolist(), whole.num_rows]
        for at, to in zip(cuts[:-1], cuts[1:], strict=True):
            if to > at and (found := compare(whole.slice(at, to - at), cosine)):
                yield found

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows = pa.concat_batches(held)
        ends = np.flatnonzero(changes(rows))
        if len(ends):
            cut = int(ends[-1]) + 1
            yield from done(rows.slice(0, cut))
            rows = rows.slice(cut)
        held = [rows]
    if held:
        yield from done(held[0])


def dedup(vectors: DataFrame, cosine: float = COSINE, tables: int = TABLES, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors (vec_id, embedding, label)."""
    e = F.col("embedding")
    plain = F.expr("forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(embedding, x -> x <> 0)")
    valid = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & e.isNotNull() & F.coalesce(plain, F.lit(False))
    # What is float at first is sent as float; all sums are of doubles.
    kind = "array<float>" if vectors.schema["embedding"].dataType == T.ArrayType(T.FloatType(), vectors.schema["embedding"].dataType.containsNull) else "array<double>"
    usable = vectors.where(valid).select("vec_id", "label", e.cast(kind).alias("embedding")).withColumn("width", F.size("embedding"))
    ids = usable.select("vec_id", "label", "width", F.sha2(F.concat_ws(",", "embedding"), 256).alias("digest"), "embedding").groupBy("vec_id").agg(F.min(F.struct("label", "width", "digest", "embedding")).alias("v")).select("vec_id", "v.*")
    ids = written(ids)
    # One row for each distinct vector of a label, with the smallest id and how many ids have it.
    reps = written(ids.groupBy("label", "width", "digest").agg(F.min_by("embedding", "vec_id").alias("embedding"), F.min("vec_id").alias("rep"), F.count("*").alias("weight")))

    def hashed(batches):
        for pdf in batches:
            for width, some in pdf.groupby("width"):
                found = codes(unit(np.concatenate(some["embedding"].to_numpy()), int(width)), tables)
                yield pd.DataFrame({"vec_id": some["rep"], "label": some["label"], "width": some["width"], "weight": some["weight"], "embedding": some["embedding"], "code": [c.ravel() for c in found]})

    coded = reps.mapInPandas(hashed, f"vec_id bigint, label {reps.schema['label'].dataType.simpleString()}, width int, weight bigint, embedding {kind}, code array<int>")
    coded = written(coded)
    # A bucket's rows are dealt to blocks by a hash of the id; how many blocks follows from its size.
    own = F.expr(f"explode(transform(sequence(0, {tables - 1}), t -> struct(t as table, array_distinct(slice(code, t * {PROBES} + 1, {PROBES})) as buckets)))").alias("t")
    spots = coded.select("vec_id", "label", "width", own).select("vec_id", "label", "width", "t.table", F.explode("t.buckets").alias("bucket"))
    bucket = ["label", "width", "table", "bucket"]
    sizes = spots.groupBy(*bucket).agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.expr(f"cast(ceil(n / {block}) as int)"))
    dealt = spots.join(sizes, bucket).withColumn("mine", F.expr("cast(pmod(xxhash64(vec_id, 5L), blocks) as int)"))
    # Each row goes to the pairs of blocks that its own is part of.
    pairs = F.explode(F.expr("transform(sequence(0, blocks - 1), o -> struct(least(o, mine) as lo, greatest(o, mine) as hi))"))
    sent = dealt.select("vec_id", *bucket, "mine", pairs.alias("p")).select("vec_id", *bucket, "mine", "p.lo", "p.hi").join(coded.select("vec_id", "weight", "embedding", "code"), "vec_id")

    # Small groups are many, so they are not dealt to a call each but sorted, and compared many at a time.
    sent = sent.select(*SENT, (F.col("mine") != F.col("lo")).alias("mine_last")).repartition(*GROUP).sortWithinPartitions(*SORTED).select(*SENT)
    found = written(sent.mapInArrow(lambda batches: compare_sorted(batches, cosine), "a bigint, b bigint, links bigint"))
    roots = components(found.where("a <> b").select("a", "b"))
    counts = found.groupBy("a").agg(F.sum("links").alias("links"))
    state = reps.select(F.col("rep"), "label", "width", "digest", "weight").join(counts, F.col("rep") == F.col("a"), "left").join(roots, F.col("rep") == F.col("node"), "left")
    state = state.select("label", "width", "digest", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    linked = ids.select("vec_id", "label", "width", "digest").join(state, ["label", "width", "digest"]).select("vec_id", "n_links", "component_id")
    all_rows = vectors.select("vec_id").join(linked, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return all_rows.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
