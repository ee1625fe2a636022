"""Bounded-space online packing of token sequences.

A document of n ids fills n div 1024 sequences of its own; the rest is placed in
the best-fitting of a fixed number of open windows of its partition.  When no
window has room and all are in use, the fullest is emitted.  What is open when a
partition ends is written out with the closed windows, and the leftovers of many
partitions are merged in a second, much smaller round, again best-fit.

A null text is an empty one (a single closing id); repeated rows are packed each; of
windows with equal room the one opened first is taken; an empty table gives an empty
result; columns other than id and text are not read.
Partition numbers make sequence ids unique; a lost task gives the same rows again,
as it reads the same rows in the same order, and the second round reads a table.
"""

from __future__ import annotations

import json
import os
import zlib
from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkclade.llm.bpe import ChunkCoder, parts
from sparkclade.llm.common import kept, written

WINDOW = 1024
#: Windows that a partition keeps open.
OPEN = 64
#: Leftover windows that one task of the second round merges.
MERGE = 20_000
#: Above all sequence ids of the first round.
MERGED = 1 << 62

def ranks_of(path: str) -> tuple[dict[bytes, int], list[str]] | None:
    """Token bytes and ids of a byte-level tokenizer file whose ids are in the order of its merges."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, special = file["model"], [t["content"] for t in file.get("added_tokens", [])]
    # Byte-level files write bytes that are no visible characters as code points from 256 on.
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    to_byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    ids = [model["vocab"][a + b] for a, b in merges]
    if ids != sorted(ids) or file.get("normalizer") or file["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
        return None
    return {bytes(to_byte[c] for c in t): i for t, i in model["vocab"].items() if t not in special}, special


def coder(path: str):
    """(chunk coder, the tokenizer's own encode, its special strings); made once in a Python worker.

    Chunks that the cache lacks are encoded together, by the same merges, with a library
    that is faster than the tokenizer's own; where the file isn't of that kind, by its own."""

    def make():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)

        def whole(chunks: list[str]) -> list[bytes]:
            return [np.array(e.ids, dtype="<u4").tobytes() for e in tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

        found = ranks_of(path)
        if found is None:
            return ChunkCoder(whole), whole, None
        ranks, special = found
        same = tiktoken.Encoding("same", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        width = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, i in ranks.items():
            width[i] = len(token)

        def together(chunks: list[str]) -> list[bytes]:
            """A chunk that begins with a space never shares a token with what is before it."""
            order = sorted(range(len(chunks)), key=lambda i: chunks[i][0] == " ")
            alone = next((k for k, i in enumerate(order) if chunks[i][0] == " "), len(order))
            out: list[bytes] = [b""] * len(chunks)
            for i in order[:alone]:
                out[i] = np.array(same.encode_ordinary(chunks[i]), dtype="<u4").tobytes()
            rest = order[alone:]
            if rest:
                ids = np.array(same.encode_ordinary("".join([chunks[i] for i in rest])), dtype="<u4")
                ends = np.searchsorted(np.cumsum(width[ids]), np.cumsum([len(chunks[i].encode()) for i in rest])) + 1
                raw, at = ids.tobytes(), 0
                for i, end in zip(rest, ends.tolist(), strict=True):
                    out[i] = raw[4 * at : 4 * end]
                    at = end
            return out

        return ChunkCoder(together), whole, special

    return kept(("packing", path), make)


def token_bytes(path: str, texts: list[str]) -> list[bytes]:
    """Each text's ids and a closing 0, as little-endian unsigned 32-bit integers."""
    cached, whole, special = coder(path)
    if special is None:
        return [ids + b"\0\0\0\0" for ids in whole(texts)]
    # A special token's string is matched before the text is split, so such texts go to the tokenizer entire.
    plain = [i for i, t in enumerate(texts) if not any(s in t for s in special)]
    odd = sorted(set(range(len(texts))).difference(plain))
    found = dict(zip(plain, cached([texts[i] for i in plain]), strict=True)) | dict(zip(odd, whole([texts[i] for i in odd]), strict=True))
    return [found[i] + b"\0\0\0\0" for i in range(len(texts))]


class Windows:
    """A fixed number of open windows; add() gives the windows that it closes."""

    def __init__(self, size: int, limit: int):
        self.size, self.limit, self.free, self.items, self.made = size, limit, [], {}, 0

    def add(self, length: int, item) -> list[tuple[int, list]]:
        closed = []
        at = bisect_left(self.free, (length, -1))
        if at < len(self.free):
            room, number = self.free.pop(at)
        else:
            if len(self.free) >= self.limit:
                _, full = self.free.pop(0)
                closed.append((full, self.items.pop(full)))
            room, number = self.size, self.made
            self.made += 1
            self.items[number] = []
        self.items[number].append((item, self.size - room))
        if room == length:
            closed.append((number, self.items.pop(number)))
        else:
            insort(self.free, (room - length, number))
        return closed

    def rest(self) -> list[tuple[int, list]]:
        left = sorted(self.items.items())
        self.free, self.items = [], {}
        return left


FIRST = "{id} {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, partition int, leftover boolean"


def first_round(docs: DataFrame, path: str, size: int, limit: int, id_col: str, text_col: str) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    schema = FIRST.format(id=id_col, kind=kind)

    def run(batches):
        from pyspark import TaskContext

        partition = TaskContext.get().partitionId()
        windows, rows = Windows(size, limit), []

        def batch_of(rows, arrow):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow, strict=True)], names=[id_col, *"start length ids_crc32 doc_tokens sequence_id offset partition leftover".split()])

        def close(found, leftover):
            for number, items in found:
                for (doc, start, length, crc, total), offset in items:
                    rows.append((doc, start, length, crc, total, partition << 32 | number, offset, partition, leftover))

        arrow = None
        for batch in batches:
            arrow = arrow or [batch.schema.field(0).type, *[pa.int64()] * 6, pa.int32(), pa.bool_()]
            for part in parts(batch, 1):
                texts = [t or "" for t in part.column(1).to_pylist()]
                for doc, ids in zip(part.column(0).to_pylist(), token_bytes(path, texts), strict=True):
                    total = len(ids) // 4
                    for start in range(0, total, size):
                        length = min(size, total - start)
                        crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                        close(windows.add(length, (doc, start, length, crc, total)), False)
                if len(rows) > 20_000:
                    yield batch_of(rows, arrow)
                    rows = []
        close(windows.rest(), True)
        if rows:
            yield batch_of(rows, arrow)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, size: int = WINDOW, limit: int = OPEN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    pieces = written(first_round(docs, path, size, limit, id_col, text_col))
    done, left = pieces.where("not leftover"), pieces.where("leftover")
    # One row for each leftover window: as many as partitions, times `limit`.
    items = left.groupBy("sequence_id", "partition").agg(F.sum("length").alias("length"))
    # Each task of the second round merges the leftovers of neighbouring partitions.
    group = F.floor(F.col("partition") / F.lit(max(1, MERGE // limit))).cast("int")

    def merge(pdf):
        import pandas as pd

        task = int(pdf["group"].iloc[0])
        windows, out = Windows(size, len(pdf)), []
        pdf = pdf.sort_values(["length", "sequence_id"], ascending=[False, True])
        found = []
        for length, old in zip(pdf["length"].tolist(), pdf["sequence_id"].tolist(), strict=True):
            found += windows.add(length, old)
        for number, inside in found + windows.rest():
            out += [(old, MERGED | task << 32 | number, at) for old, at in inside]
        return pd.DataFrame(out, columns=["sequence_id", "new_id", "shift"])

    moved = items.withColumn("group", group).groupBy("group").applyInPandas(merge, "sequence_id bigint, new_id bigint, shift bigint")
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens"]
    merged = left.join(moved, "sequence_id").select(*names, F.col("new_id").alias("sequence_id"), (F.col("offset") + F.col("shift")).alias("offset"))
    return done.select(*names, "sequence_id", "offset").unionByName(merged)
