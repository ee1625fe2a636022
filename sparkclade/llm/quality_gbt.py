"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics are taken from whole texts with numpy.  Trees are grown on binned
statistics of a bounded sample of labelled rows, and flattened into arrays that are
traversed for all rows of a batch at once.

A null text counts as empty and gets a score like any other; repeated rows get equal
scores, and so do tied ones; of several labels for one id the lowest counts, null labels do
not.  With no label to learn from, every score is the prior 0.5; an empty table gives an empty
result.  Columns may have any names but those that are added.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkclade.llm.bpe import parts
from sparkclade.llm.common import sent
from sparkclade.llm.shingles import _SPACE, mix, word_hashes

#: Labelled rows that training takes at most, in expectation.
SAMPLE_ROWS = 20_000
#: A row is predicted to be good from this score on.
ACCEPT = 0.7

_CLASSES = ["lower", "upper", "digit", "space", "newline", "stop", "comma", "exclaim", "bar", "symbol", "quote", "slash", "other", "high"]
_CLASS = np.full(256, _CLASSES.index("other"), dtype=np.uint8)
for _name, _bytes in {
    "lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "space": b" \t\r\v\f", "newline": b"\n", "stop": b".", "comma": b",;", "exclaim": b"!?",
    "bar": b"|", "symbol": b"#*$%&<>=+~^", "quote": b"'\"`", "slash": b"/\\@_", "high": bytes(range(128, 256)),
}.items():
    _CLASS[list(_bytes)] = _CLASSES.index(_name)

FEATURES = [
    *(f"share_{c}" for c in _CLASSES), "log_bytes", "log_words", "word_bytes", "distinct_words", "top_word", "repeated_triples",
    "line_bytes", "distinct_lines", "words_end_symbol", "words_upper", "words_digit", "short_words", "long_words", "stops_per_word",
]


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of FEATURES for each text."""
    out = np.zeros((len(texts), len(FEATURES)))
    hashes, at = word_hashes(texts)
    triples = mix(hashes[:-2] + mix(hashes[1:-1] + mix(hashes[2:]))) if len(hashes) > 2 else hashes[:0]
    for row, text in enumerate(texts):
        b = np.frombuffer(text, dtype=np.uint8)
        n = max(1, len(b))
        shares = np.bincount(_CLASS[b], minlength=len(_CLASSES)) / n
        words = hashes[at[row] : at[row + 1]]
        m = max(1, len(words))
        space = _SPACE[b]
        start = np.flatnonzero(~space & np.concatenate(([True], space[:-1]))) if len(b) else np.zeros(0, dtype=np.int64)
        end = np.flatnonzero(~space & np.concatenate((space[1:], [True]))) if len(b) else start
        first, final = _CLASS[b[start]], _CLASS[b[end]]
        second = _CLASS[b[np.minimum(start + 1, end)]]
        size = end - start + 1
        _, often = np.unique(words, return_counts=True)
        mine = triples[at[row] : max(at[row], at[row + 1] - 2)]
        lines = text.split(b"\n")
        full = [x for x in lines if x.strip()]
        symbol = np.isin(final, [_CLASSES.index(c) for c in ("exclaim", "symbol", "bar", "slash", "other")])
        out[row] = [
            *shares, np.log1p(len(b)), np.log1p(len(words)), size.sum() / m, len(often) / m, often.max(initial=0) / m, 1 - len(np.unique(mine)) / max(1, len(mine)),
            len(b) / max(1, len(lines)), len(set(full)) / max(1, len(full)), symbol.sum() / m, ((first == 1) & (second == 1)).sum() / m, (first == 2).sum() / m, (size <= 2).sum() / m, (size > 14).sum() / m, text.count(b".") / m,
        ]
    return out


class Trees:
    """Flattened trees: node k of tree t is at [t, k], its children at 2k + 1 and 2k + 2."""

    def __init__(self, depth: int = 4, rounds: int = 80, rate: float = 0.2, bins: int = 64, least: int = 8, l2: float = 1.0):
        self.depth, self.rounds, self.rate, self.bins, self.least, self.l2 = depth, rounds, rate, bins, least, l2
        self.base = 0.0
        self.feature = np.zeros((0, 1), dtype=np.int32)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        code = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        inner, nodes = 2**self.depth - 1, 2 ** (self.depth + 1) - 1
        self.feature = np.zeros((self.rounds, inner), dtype=np.int32)
        self.above = np.full((self.rounds, inner), np.inf)
        self.value = np.zeros((self.rounds, nodes))
        margin = np.full(len(y), self.base)
        for t in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, p * (1 - p)
            node = np.zeros(len(y), dtype=np.int64)
            for k in range(inner):
                rows = np.flatnonzero(node == k)
                if len(rows) >= 2 * self.least:
                    self._split(t, k, rows, code, g, h, edges)
                # Without a split all rows go left.
                node[rows] = 2 * k + 1 + (x[rows, self.feature[t, k]] > self.above[t, k])
            leaf_g = np.bincount(node, weights=g, minlength=nodes)
            leaf_h = np.bincount(node, weights=h, minlength=nodes)
            self.value[t] = -self.rate * leaf_g / (leaf_h + self.l2)
            margin += self.value[t][node]
        return self

    def _split(self, t, k, rows, code, g, h, edges) -> None:
        best = 1e-6
        total_g, total_h = g[rows].sum(), h[rows].sum()
        for f in range(code.shape[1]):
            if not len(edges[f]):
                continue
            c = code[rows, f]
            left_g = np.cumsum(np.bincount(c, weights=g[rows], minlength=len(edges[f]) + 1))[:-1]
            left_h = np.cumsum(np.bincount(c, weights=h[rows], minlength=len(edges[f]) + 1))[:-1]
            left_n = np.cumsum(np.bincount(c, minlength=len(edges[f]) + 1))[:-1]
            gain = left_g**2 / (left_h + self.l2) + (total_g - left_g) ** 2 / (total_h - left_h + self.l2) - total_g**2 / (total_h + self.l2)
            gain[(left_n < self.least) | (len(rows) - left_n < self.least)] = 0
            at = int(np.argmax(gain))
            if gain[at] > best:
                best, self.feature[t, k], self.above[t, k] = gain[at], f, edges[f][at]

    def score(self, x: np.ndarray) -> np.ndarray:
        rows, margin = np.arange(len(x)), np.full(len(x), self.base)
        for t in range(len(self.feature)):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, self.feature[t, node]] > self.above[t, node])
            margin += self.value[t][node]
        return 1 / (1 + np.exp(-margin))


def _texts(column: pa.Array) -> list[bytes]:
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def train(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", limit: int = SAMPLE_ROWS) -> Trees:
    """Trees from a sample of the labelled rows for which `learn` holds: `limit` ids in expectation.

    Which ids are drawn depends on their hash only."""
    known = labels.where(learn & F.col("quality").isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min("quality").alias("label"))
    rate = min(1.0, limit / max(known.count(), 1))
    drawn = known.where(F.pmod(F.xxhash64("id", F.lit(29)), F.lit(1 << 30)) < int(rate * (1 << 30)))

    def run(batches):
        for batch in batches:
            for part in parts(batch, 1):
                rows = statistics(_texts(part.column(1))).astype(np.float32)
                stats = pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)), pa.array(rows.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int32()), stats], names=["label", "stats"])

    # The sample bounds the broadcast; an id that repeats in the documents is learnt from once.
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(drawn), "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    found = rows.select("label", "text").mapInArrow(run, "label int, stats array<float>").toPandas()
    model = Trees()
    if len(found) and found["label"].nunique() > 1:
        x = np.array(found["stats"].tolist(), dtype=np.float64)
        order = np.lexsort(x.T)
        model.fit(x[order], found["label"].to_numpy(dtype=np.float64)[order])
    elif len(found):
        model.base = 4.0 if found["label"].iloc[0] else -4.0
    return model


def predict(docs: DataFrame, trees: Trees, columns: list[str], text_col: str = "text", names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """The columns of docs with score and predicted; only the text is looked at, once."""
    model = sent(docs.sparkSession, trees)
    given = docs.select(*(F.col(f"`{c}`") for c in columns if c != text_col), F.col(f"`{text_col}`"))
    kept = len(given.columns) - (text_col not in columns)

    def run(batches):
        for batch in batches:
            for part in parts(batch, part_of := batch.num_columns - 1):
                score = model.value.score(statistics(_texts(part.column(part_of))).astype(np.float32).astype(np.float64))
                yield pa.RecordBatch.from_arrays([*part.columns[:kept], pa.array(score), pa.array((score >= ACCEPT).astype(np.int32))], names=[*part.schema.names[:kept], *names])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:kept]), f"`{names[0]}` double", f"`{names[1]}` int"])
    return given.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows of the fold that nothing is learnt from; a null id belongs to no fold."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
