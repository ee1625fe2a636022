"""N-gram Jaccard join: a grouped prefix join over sets of word shingles.

Texts become sets of five-word shingles.  Shingles are ordered from rare to frequent
by a count sketch of all texts (any order all tasks agree on is right; this one keeps
frequent ones out of the prefixes).  Two sets with Jaccard similarity of at least t
share a shingle among the first n - ceil(t n) + 1 of each, their prefixes.

 1. Texts with identical prefix and size form one group (equal texts among them).
 2. Groups are dealt by the shingles of their prefixes.  Groups that share a shingle
    which few groups have are paired; where many have it, each is tied to the most
    central group instead, so the work is linear in their number.
 3. Pairs and ties are expanded to distinct sets; those that cannot be similar by size
    and a histogram of their hashes need no sets; the rest are verified by exact intersection.
 4. Behind a tie, sets that did not link to the central one are still compared with
    all others of the same centre, block against block; only sets already linked to
    the centre need no comparison with each other, as they are connected.
 5. Links are joined up to components.

A set is named by its smallest id.  Empty texts have no set and link with nothing; a
row with a null id links with nothing and has no component; rows that share an id
count as one document; an empty table gives an empty result.  Ties of frequency and of
centrality are broken by hashes, and change no link; columns other than id and text are
not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkclade.llm.bpe import parts
from sparkclade.llm.common import components, let_go, sent, small, written
from sparkclade.llm.shingles import SEGMENT, mix, shingle_sets

#: Similarity threshold as a fraction of integers.
SHARE, WHOLE = 3, 4
#: Cells of the count sketch, as a power of two: its size is fixed, 4 bytes for each in the tasks that count, 1 where it is sent.
SKETCH_BITS = 23
#: Cells in a row of the sketch table.
SKETCH_ROW = 1 << 18
#: Parts of the sketch that one task adds up; more are added in rounds.
FAN = 64
#: Groups sharing a shingle that are paired; where more do, they are tied to a centre.
PAIRED = 12
#: A shingle whose cell counts more than this is dealt to several tasks.
SALTED = 4096
#: Sets in a block of the comparisons behind a tie.
BLOCK = 128

_U = np.uint64


def cells(sets: np.ndarray) -> np.ndarray:
    return (sets >> _U(64 - SKETCH_BITS)).astype(np.int64)


def histogram(shingles: np.ndarray) -> bytes:
    """How many of a set's hashes begin with which bits: two sets have no more in common than
    the sum of the smaller counts.  Two to four hashes fall on a counter, whatever the size."""
    bits = (len(shingles) // 4).bit_length()
    places = (shingles >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(shingles), dtype=np.int64)
    return np.minimum(np.bincount(places, minlength=1 << bits), 0xFF).astype(np.uint8).tobytes()


def possible(n: np.ndarray, m: np.ndarray, x: list[bytes], y: list[bytes]) -> np.ndarray:
    """Which pairs of sets of n and m shingles, with histograms x and y, can be similar enough."""
    fits = WHOLE * np.minimum(n, m) >= SHARE * np.maximum(n, m)
    widths = np.array([(len(p), len(q)) for p, q in zip(x, y, strict=True)], dtype=np.int64).reshape(-1, 2)
    for a, b in np.unique(widths[fits], axis=0).tolist():
        rows = np.flatnonzero(fits & (widths == (a, b)).all(axis=1))
        p, q = (np.frombuffer(b"".join([v[i] for i in rows.tolist()]), dtype=np.uint8).reshape(len(rows), -1) for v in (x, y))
        # A full counter says nothing.
        full = (p == 0xFF).any(axis=1) | (q == 0xFF).any(axis=1)
        least = min(a, b)
        p, q = (v.reshape(len(rows), least, -1).sum(axis=2, dtype=np.int64) for v in (p, q))
        most = np.minimum(p, q).sum(axis=1)
        fits[rows] = full | (WHOLE * most >= SHARE * (n[rows] + m[rows] - most))
    return fits


def _texts(column: pa.Array) -> list[bytes]:
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def _scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One pass over all texts: for each row its set's size, fingerprint and histogram, and the task's part of the sketch.

    Rows with a cell_row are compressed rows of the sketch."""

    def run(batches):
        let_go()
        sketch = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
        for batch in batches:
            for part in parts(batch, 1, SEGMENT):
                sets = shingle_sets(_texts(part.column(1)))
                if sets:
                    np.add.at(sketch, cells(np.concatenate(sets)), 1)
                first = np.array([s.sum(dtype=np.uint64) for s in sets], dtype=np.uint64)
                second = np.array([mix(s).sum(dtype=np.uint64) for s in sets], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(first.view(np.int64)), pa.array(second.view(np.int64)), pa.nulls(len(sets), pa.int32()), pa.array([histogram(s) for s in sets], pa.binary())],
                    names=["id", "n", "print1", "print2", "cell_row", "counts"],
                )
        # A task without shingles has nothing to add.
        blocks = {i: zlib.compress(x.tobytes(), 1) for i, x in enumerate(sketch.reshape(-1, SKETCH_ROW)) if x.any()}
        none = pa.nulls(len(blocks), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(list(blocks), pa.int32()), pa.array(list(blocks.values()), pa.binary())], names=["id", "n", "print1", "print2", "cell_row", "counts"])

    return docs.select(id_col, text_col).mapInArrow(run, "id bigint, n bigint, print1 bigint, print2 bigint, cell_row int, counts binary")


def _sketch(scanned: DataFrame) -> tuple[np.ndarray, float]:
    """The sum of all parts, in rounds of about FAN: the driver gets as many bytes as the sketch has, whatever the input."""

    def add(pdf):
        total = np.zeros(SKETCH_ROW, dtype=np.int64)
        for x in pdf["counts"]:
            total += np.frombuffer(zlib.decompress(x), dtype=np.uint32)
        capped = np.minimum(total, 0xFFFFFFFF).astype(np.uint32)
        return pd.DataFrame({"cell_row": pdf["cell_row"].iloc[:1], "counts": [zlib.compress(capped.tobytes(), 1)]})

    schema = "cell_row int, counts binary"
    left = scanned.where("cell_row is not null").select("cell_row", "counts")
    most = left.groupBy("cell_row").count().agg(F.max("count")).first()[0] or 0
    while most > FAN:
        most = -(-most // FAN)
        left = left.withColumn("salt", F.expr(f"cast(pmod(xxhash64(counts), {most}L) as int)")).groupBy("cell_row", "salt").applyInPandas(lambda pdf: add(pdf), schema)
    out = np.zeros(((1 << SKETCH_BITS) // SKETCH_ROW, SKETCH_ROW), dtype=np.uint32)
    for r in left.groupBy("cell_row").applyInPandas(lambda pdf: add(pdf), schema).collect():
        out[r["cell_row"]] = np.frombuffer(zlib.decompress(r["counts"]), dtype=np.uint32)
    return ranks(out.ravel())


def ranks(counts: np.ndarray) -> tuple[np.ndarray, float]:
    """How frequent a cell's shingles are, from 0 to 63, two steps for each doubling.

    The median is what a cell of rare shingles holds; what is above it is measured in
    units of its noise, so that the order stays useful when all cells are well filled."""
    usual = _median(counts)
    out = np.empty(len(counts), dtype=np.uint8)
    for at in range(0, len(counts), SKETCH_ROW):
        above = np.maximum(counts[at : at + SKETCH_ROW].astype(np.float64) - usual, 0)
        out[at : at + SKETCH_ROW] = np.minimum(63, np.floor(2 * np.log2(above / _noise(usual) + 1)))
    return out, _noise(usual)


def _median(counts: np.ndarray) -> float:
    """The lower median, found by halving the range, as a copy of all counts would fill the driver."""
    low, high = 0, int(counts.max(initial=0))
    while low < high:
        middle = (low + high) // 2
        if 2 * int(np.count_nonzero(counts <= middle)) >= len(counts):
            high = middle
        else:
            low = middle + 1
    return float(low)


def _noise(usual: float) -> float:
    return 1 + usual**0.5


def salts_of(noise: float) -> np.ndarray:
    """Parts that the shingles of each rank are dealt to, by the most that they count."""
    return 1 + (noise * 2.0 ** ((np.arange(64) + 1) / 2) / SALTED).astype(np.int64)


def prefix(shingles: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """A set's first shingles, rarest first, the ranks of their cells, and the set's centrality."""
    n = len(shingles)
    often = sketch[cells(shingles)]
    keys = (often.astype(np.uint64) << _U(58)) | (shingles >> _U(6))
    order = np.argsort(keys)
    take = order[: n - -(-SHARE * n // WHOLE) + 1]
    return keys[take], often[take], int(500 * often.mean())


def _prefixes(docs: DataFrame, sketch, id_col: str, text_col: str) -> DataFrame:
    """(token, salt, hot, grp, n, centre) for each shingle of each group's prefix, and a row (hot -1, the id as token) that gives each id's group."""

    def run(batches):
        (table, noise), seen = sketch.value, set()
        parts_of = salts_of(noise)
        for batch in batches:
            for part in parts(batch, 1, SEGMENT):
                columns: list[list[np.ndarray]] = [[] for _ in range(6)]
                for doc, s in zip(part.column(0).to_pylist(), shingle_sets(_texts(part.column(1))), strict=True):
                    if doc is None or not len(s):
                        continue
                    keys, often, centre = prefix(s, table)
                    grp = int(mix(keys + mix(np.arange(len(keys), dtype=np.uint64))).sum(dtype=np.uint64)) ^ (len(s) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
                    grp = np.array([grp], dtype=np.uint64).view(np.int64)[0]
                    # In one task a group's shingles are sent once.
                    fresh = grp not in seen
                    if fresh and len(seen) < 200_000:
                        seen.add(grp)
                    k = len(keys) if fresh else 0
                    salts = parts_of[often[:k]]
                    mine = (int(grp) & 0x7FFFFFFF) % salts
                    for out, values in zip(columns, (np.append(keys[:k].view(np.int64), doc), np.append(mine, 0), np.append((salts > 1).astype(np.int8), -1), np.full(k + 1, grp), np.full(k + 1, len(s)), np.full(k + 1, centre)), strict=True):
                        out.append(values)
                if columns[0]:
                    token, salt, hot, grp, n, centre = (np.concatenate(c) for c in columns)
                    yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(salt, pa.int32()), pa.array(hot, pa.int8()), pa.array(grp), pa.array(n, pa.int32()), pa.array(centre, pa.int32())], names=["token", "salt", "hot", "grp", "n", "centre"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "token bigint, salt int, hot tinyint, grp bigint, n int, centre int")


#: Kinds of rows that the pass over dealt prefixes gives out.
PAIR, TIE, HOT_TIE, MEMBER, HOT_HUB = range(5)
FOUND = "kind tinyint, token bigint, a bigint, b bigint, centre int"


def _runs(token, salt, hot, grp, n, centre) -> list[tuple[np.ndarray, ...]]:
    """What whole runs of rows, sorted by (token, salt, hot, grp), give: tuples like FOUND."""
    out = []
    is_member = hot < 0
    if is_member.any():
        out.append((MEMBER, np.zeros(is_member.sum(), dtype=np.int64), token[is_member], grp[is_member], 0))
    keep = ~is_member
    keep[1:] &= (token[1:] != token[:-1]) | (salt[1:] != salt[:-1]) | (grp[1:] != grp[:-1]) | is_member[:-1]
    token, salt, hot, grp, n, centre = (x[keep] for x in (token, salt, hot, grp, n, centre))
    if not len(token):
        return out
    start = np.flatnonzero(np.concatenate(([True], (token[1:] != token[:-1]) | (salt[1:] != salt[:-1]))))
    size = np.diff(np.append(start, len(token)))
    for d in range(2, PAIRED + 1):
        rows = start[(size == d) & (hot[start] == 0)]
        if len(rows):
            i, j = np.triu_indices(d, 1)
            x, y = (rows[:, None] + i).ravel(), (rows[:, None] + j).ravel()
            fits = WHOLE * np.minimum(n[x], n[y]).astype(np.int64) >= SHARE * np.maximum(n[x], n[y]).astype(np.int64)
            x, y = x[fits], y[fits]
            # The same pair mostly shares more shingles.
            both = np.unique(np.stack([grp[x], grp[y]], axis=1), axis=0)
            out.append((PAIR, np.zeros(len(both), dtype=np.int64), both[:, 0], both[:, 1], 0))
    for at in np.flatnonzero((size > PAIRED) | (hot[start] > 0)).tolist():
        rows = slice(start[at], start[at] + size[at])
        hub = start[at] + int(np.lexsort((grp[rows], centre[rows]))[-1])
        others = grp[rows][grp[rows] != grp[hub]]
        is_hot = hot[start[at]] > 0
        out.append((HOT_TIE if is_hot else TIE, np.full(len(others) + is_hot, token[hub] if is_hot else 0), np.append(others, grp[hub]) if is_hot else others, np.full(len(others) + is_hot, grp[hub]), 0))
        if is_hot:
            out.append((HOT_HUB, token[hub : hub + 1], grp[hub : hub + 1], grp[hub : hub + 1], int(centre[hub])))
    return out


def _pass(dealt: DataFrame) -> DataFrame:
    """Rows of FOUND from prefixes that are dealt, and sorted, by shingle.

    Runs of a shingle are bounded: a frequent one is dealt to several tasks by its count."""

    def run(batches):
        held: list[np.ndarray] = [np.zeros(0, dtype=t) for t in ("i8", "i4", "i1", "i8", "i4", "i4")]

        def rows(columns):
            found = _runs(*columns)
            if found:
                kinds = np.concatenate([np.full(len(f[2]), f[0], dtype=np.int8) for f in found])
                centres = np.concatenate([np.full(len(f[2]), f[4], dtype=np.int32) for f in found])
                yield pa.RecordBatch.from_arrays([pa.array(kinds), *(pa.array(np.concatenate([f[k] for f in found]).astype(np.int64)) for k in (1, 2, 3)), pa.array(centres)], names=["kind", "token", "a", "b", "centre"])

        for batch in batches:
            held = [np.concatenate([h, batch.column(i).to_numpy(zero_copy_only=False)]) for i, h in enumerate(held)]
            token, salt = held[0], held[1]
            change = np.flatnonzero((token[1:] != token[:-1]) | (salt[1:] != salt[:-1]))
            if len(change):
                cut = change[-1] + 1
                yield from rows([h[:cut] for h in held])
                held = [h[cut:] for h in held]
        if len(held[0]):
            yield from rows(held)

    ordered = dealt.repartition("token", "salt").sortWithinPartitions("token", "salt", "hot", "grp")
    return ordered.mapInArrow(run, FOUND)


def _candidates(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of groups, and ties (a, hub) of groups to centres."""
    pairs = found.where(f"kind = {PAIR}").select("a", "b")
    ties = found.where(f"kind = {TIE}").select("a", F.col("b").alias("hub"))
    # The parts of a frequent shingle have a centre each; the most central one is that of all.
    hubs = found.where(f"kind = {HOT_HUB}").groupBy("token").agg(F.max(F.struct("centre", "b")).alias("best")).select("token", F.col("best.b").alias("hub"))
    hot = found.where(f"kind = {HOT_TIE}").select("token", "a").join(hubs, "token").where("a <> hub").select("a", "hub")
    return pairs, ties.union(hot).distinct()


def _possible(edges: DataFrame, rows: DataFrame) -> DataFrame:
    """(a, b, tie, open): open edges join sets that can be similar enough by size and histogram; of the others only ties stay."""
    known = rows.select("id", "n", "counts")
    both = edges.join(known.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("counts").alias("ha")), "a")
    both = both.join(known.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("counts").alias("hb")), "b")

    def run(batches):
        for batch in batches:
            n, m = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 4))
            fits = pa.array(possible(n, m, batch.column(5).to_pylist(), batch.column(6).to_pylist()))
            marked = pa.RecordBatch.from_arrays([*batch.columns[:3], fits], names=["a", "b", "tie", "open"])
            yield marked.filter(pc.or_(fits, batch.column(2)))

    return both.select("a", "b", "tie", "na", "nb", "ha", "hb").mapInArrow(run, "a bigint, b bigint, tie boolean, open boolean").distinct()


def _overlaps(rows: DataFrame) -> DataFrame:
    """(a, b, hub, inter, na, nb) from rows that hold both sets."""

    def run(batches):
        for batch in batches:
            a, b = (batch.column(i).to_pylist() for i in (3, 4))
            x = [np.frombuffer(v, dtype=np.uint64) for v in a]
            y = [np.frombuffer(v, dtype=np.uint64) for v in b]
            inter = [_common(p, q) for p, q in zip(x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *(pa.array(v, pa.int64()) for v in (inter, [len(p) for p in x], [len(q) for q in y]))], names=["a", "b", "tie", "inter", "na", "nb"])

    return rows.select("a", "b", "tie", "set_a", "set_b").mapInArrow(run, "a bigint, b bigint, tie boolean, inter bigint, na bigint, nb bigint")


def _common(x: np.ndarray, y: np.ndarray) -> int:
    if not len(x) or not len(y):
        return 0
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


def _forest(pdf: pd.DataFrame) -> pd.DataFrame:
    """A spanning forest of the links between the unlinked sets of one block and the sets of another."""
    from sparkclade.llm.embeddings import forest

    left, right = (pdf[pdf["side"] == s].drop_duplicates("id") for s in (0, 1))
    if len(left) and len(right):
        sets = [np.frombuffer(v, dtype=np.uint64) for v in right["shingles"]]
        sizes = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(sets)), sizes)
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        a, b = [], []
        for i, v in enumerate(left["shingles"]):
            x = np.frombuffer(v, dtype=np.uint64)
            lo, hi = np.searchsorted(flat, x, "left"), np.searchsorted(flat, x, "right")
            many = hi - lo
            at = np.repeat(lo - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
            inter = np.bincount(owner[at], minlength=len(sets))
            linked = np.flatnonzero(WHOLE * inter >= SHARE * (len(x) + sizes - inter))
            a += [i] * len(linked)
            b += (linked + len(left)).tolist()
        ids = np.concatenate([left["id"].to_numpy(), right["id"].to_numpy()])
        x, y = forest(np.array(a, dtype=np.int64), np.array(b, dtype=np.int64), len(ids))
        return pd.DataFrame({"a": ids[x], "b": ids[y]})
    return pd.DataFrame({"a": [], "b": []}, dtype="int64")


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, shingles) of the wanted ids' texts."""

    def run(batches):
        for batch in batches:
            for part in parts(batch, 1, SEGMENT):
                sets = shingle_sets(_texts(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "shingles"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_col).join(small(wanted), "id", "left_semi")
    return rows.mapInArrow(run, "id bigint, shingles binary")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row."""
    spark = docs.sparkSession
    scanned = written(_scan(docs, id_col, text_col))
    sketch = sent(spark, _sketch(scanned))
    rows = scanned.where("cell_row is null").select("id", "n", "print1", "print2", "counts")
    # Each distinct set by its smallest id.
    named = rows.where("n > 0 and id is not null").groupBy("n", "print1", "print2").agg(F.min("id").alias("rep"))
    named = written(named)
    found = written(_pass(_prefixes(docs, sketch, id_col, text_col)).distinct())
    pairs, ties = _candidates(found)
    members = found.where(f"kind = {MEMBER}").select(F.col("a").alias("rep"), F.col("b").alias("grp"))
    groups = written(members.join(named.select("rep").distinct(), "rep").select("grp", "rep").distinct())
    several = groups.groupBy("grp").agg(F.count("*").alias("c"), F.min("rep").alias("hub")).where("c > 1").join(groups, "grp").where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b"), F.lit(True).alias("tie"))
    left, right = groups.select(F.col("grp").alias("ga"), F.col("rep").alias("a")), groups.select(F.col("grp").alias("gb"), F.col("rep").alias("b"))
    hubs = groups.groupBy("grp").agg(F.min("rep").alias("b")).select(F.col("grp").alias("gb"), "b")
    expanded = pairs.select(F.col("a").alias("ga"), F.col("b").alias("gb")).join(left, "ga").join(right, "gb").select("a", "b", F.lit(False).alias("tie"))
    held = ties.select(F.col("a").alias("ga"), F.col("hub").alias("gb")).join(left, "ga").join(hubs, "gb").select("a", "b", F.lit(True).alias("tie"))
    edges = written(_possible(expanded.union(held).union(several).where("a <> b").distinct(), rows))
    wanted = edges.select(F.col("a").alias("id")).union(edges.where("open").select("b")).distinct()
    sets = written(_sets(docs, wanted, id_col, text_col))
    both = edges.where("open").join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("set_a")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("set_b")), "b")
    shut = edges.where("not open").select("a", "b", "tie", F.lit(0).cast("long").alias("inter"), F.lit(1).cast("long").alias("na"), F.lit(1).cast("long").alias("nb"))
    checked = written(_overlaps(both).union(shut))
    linked = f"{WHOLE} * inter >= {SHARE} * (na + nb - inter)"
    links = checked.where(linked).select("a", "b").union(_behind(checked, sets, linked))
    roots = components(links)
    whole = rows.drop("counts").join(named, ["n", "print1", "print2"], "left").join(roots, F.col("rep") == F.col("node"), "left")
    return whole.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("root", "rep", "id")).alias("component_id"))


def _behind(checked: DataFrame, sets: DataFrame, linked: str) -> DataFrame:
    """Links of sets that are not linked to the centre they are tied to, with the others of that centre."""
    tied = checked.where("tie")
    blocks = "cast(ceil({0} / %d) as int)" % BLOCK
    hubs = written(tied.groupBy("b").agg(F.count("*").alias("every"), F.sum(F.expr(f"if({linked}, 0, 1)")).alias("loose")).where("loose > 0").selectExpr("b", f"{blocks.format('loose')} as rows", f"{blocks.format('every')} as cols"))
    # A row for each centre that has such sets; where they are few, no set is dealt by its centre.
    known = small(hubs)
    mine = "cast(pmod(xxhash64(a, 3L), {0}) as int)"
    left = tied.where(f"not ({linked})").join(known, "b").select("b", F.col("a").alias("id"), F.expr(mine.format("rows")).alias("r"), F.explode(F.expr("sequence(0, cols - 1)")).alias("c"), F.lit(0).alias("side"))
    right = tied.join(known, "b").select("b", F.col("a").alias("id"), F.explode(F.expr("sequence(0, rows - 1)")).alias("r"), F.expr(mine.format("cols")).alias("c"), F.lit(1).alias("side"))
    sent = left.unionByName(right).join(sets, "id")
    return sent.groupBy("b", "r", "c").applyInPandas(_forest, "a bigint, b bigint")
