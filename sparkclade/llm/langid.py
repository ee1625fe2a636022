"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary; a
word's probability is the sum, over all ways to cut it into pieces, of the product
of their probabilities (a forward algorithm, vectorised over words).  A text's
score is the sum over its words.  Training is expectation-maximisation of the same
model on a sample of labelled texts.

Words are runs of letters, lower-cased and cut after 16 letters; all pieces of the
vocabulary that can be part of one are used.  A null text, or one without a letter, is
`und` with score 0; rows are independent of each other, so repeated rows get equal
results (of languages with equal scores the first by name is taken).  With no row to
learn from, every text is `und`; an empty table gives an empty result.  Other columns
may have any names but those that are added.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkclade.llm.bpe import CACHE, parts, read_ranks
from sparkclade.llm.common import kept as kept_in_worker
from sparkclade.llm.common import sent, written

WORD = re.compile(r"[^\W\d_]{1,16}")
#: Bytes of text that training takes at most, over all languages.
SAMPLE_BYTES = 2_400_000
#: Distinct texts that training takes of each language at least, where there are as many.
LEAST = 16
#: Bytes that a word has at most: a space, and 16 letters of up to four.
LONGEST = 65
STEPS = 4
#: Share of each language's distribution that comes from all languages together.
SHARED = 0.02
#: Factor for each byte that keeps the sums of long words in range.  A text that a language
#: explains no better than letters drawn from so many has a sum of logs below 0.
SCALE = 24.0
#: Words that are worked on together.
TOGETHER = 8192

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


class Pieces:
    """The vocabulary as sorted hashes of the beginnings of its pieces, by their lengths."""

    def __init__(self, vocabulary: list[bytes]):
        kept = sorted({t for t in vocabulary if len(t) <= LONGEST})
        self.lengths = np.array([len(t) for t in kept], dtype=np.float64)
        self.count = len(kept)
        begun: dict[int, dict[int, int]] = {}
        for i, token in enumerate(kept):
            h = 0
            for k, byte in enumerate(token, 1):
                h = (h * int(_BASE) + byte + 1) & 0xFFFFFFFFFFFFFFFF
                begun.setdefault(k, {}).setdefault(h, -1)
            begun[len(token)][h] = i
        #: For each length the hashes of beginnings, and the piece that each is, or -1.
        self.begun = [(np.array(sorted(of), dtype=np.uint64), np.array([of[h] for h in sorted(of)], dtype=np.int64)) for _, of in sorted(begun.items())]


class Lattice:
    """All pieces in all places of some words: arrays in the order of their ends, cut into runs of equal end and length."""

    def __init__(self, pieces: Pieces, words: list[bytes]):
        self.size = np.array([len(w) for w in words])
        self.width = int(self.size.max())
        b = np.frombuffer(b"".join([w.ljust(self.width, b"\0") for w in words]), dtype=np.uint8).reshape(len(words), self.width).astype(np.uint64) + np.uint64(1)
        word, start = np.nonzero(np.arange(self.width)[None, :] < self.size[:, None])
        code, found = np.zeros(len(word), dtype=np.uint64), []
        for k, (codes, ids) in enumerate(pieces.begun, 1):
            inside = start + k <= self.size[word]
            word, start, code = word[inside], start[inside], code[inside]
            if not len(word):
                break
            code = code * _BASE + b[word, start + k - 1]
            at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            goes_on = codes[at] == code
            word, start, code, piece = word[goes_on], start[goes_on], code[goes_on], ids[at[goes_on]]
            is_piece = piece >= 0
            found.append((word[is_piece], start[is_piece] + k, piece[is_piece], np.full(int(is_piece.sum()), k)))
        word, end, piece, length = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.lexsort((length, end))
        self.word, self.piece, end, length = word[order], piece[order], end[order], length[order]
        cuts = np.flatnonzero((end[1:] != end[:-1]) | (length[1:] != length[:-1])) + 1
        first = np.concatenate(([0], cuts))
        last = np.append(first[1:], len(end))
        #: (end, length, from, to) of each run; within one, words differ.
        self.runs = list(zip(end[first].tolist(), length[first].tolist(), first.tolist(), last.tolist(), strict=True)) if len(end) else []

    def forward(self, table: np.ndarray) -> np.ndarray:
        """alpha[end, word, language]: scaled probability of each word's first `end` bytes."""
        alpha = np.zeros((self.width + 1, len(self.size), table.shape[1]))
        alpha[0] = 1
        for end, k, a, b in self.runs:
            alpha[end, self.word[a:b]] += alpha[end - k, self.word[a:b]] * table[self.piece[a:b]]
        return alpha

    def totals(self, alpha: np.ndarray) -> np.ndarray:
        return np.maximum(alpha[self.size, np.arange(len(self.size))], 1e-300)

    def expected(self, table: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """How often each language uses which piece, summed over all ways to cut the words."""
        alpha = self.forward(table)
        beta = np.zeros_like(alpha)
        beta[self.size, np.arange(len(self.size))] = weight / self.totals(alpha)
        gain = np.zeros((len(self.word), table.shape[1]))
        for end, k, a, b in reversed(self.runs):
            part = beta[end, self.word[a:b]] * table[self.piece[a:b]]
            beta[end - k, self.word[a:b]] += part
            gain[a:b] = alpha[end - k, self.word[a:b]] * part
        return self.summed(gain, len(table))

    def summed(self, values: np.ndarray, count: int) -> np.ndarray:
        return np.stack([np.bincount(self.piece, weights=values[:, i], minlength=count) for i in range(values.shape[1])], axis=1)


class Model:
    def __init__(self, vocabulary: list[bytes], languages: list[str]):
        self.languages = languages
        self.pieces = Pieces(vocabulary)
        self.probability = np.zeros((self.pieces.count, len(languages)))

    def table(self) -> np.ndarray:
        return self.probability * (SCALE**self.pieces.lengths)[:, None]

    def fit(self, counts: list[dict[bytes, int]]) -> None:
        """counts: for each language how often it has which word."""
        words = sorted(set().union(*counts), key=lambda w: (len(w), w))
        used = np.zeros_like(self.probability)
        for step in range(STEPS + 1):
            table, used = self.table(), np.zeros_like(used)
            for at in range(0, len(words), TOGETHER):
                some = words[at : at + TOGETHER]
                weight = np.array([[c.get(w, 0) for c in counts] for w in some], dtype=np.float64)
                lattice = Lattice(self.pieces, some)
                used += lattice.expected(table, weight) if step else lattice.summed(weight[lattice.word], len(used))
            self._set(used)

    def _set(self, used: np.ndarray) -> None:
        """Distributions from (expected) counts, smoothed by all languages' and by single bytes."""
        base = np.where(self.pieces.lengths == 1, 1e-3, 1e-7)[:, None]
        share = used / np.maximum(used.sum(axis=0), 1e-9)
        both = share.mean(axis=1, keepdims=True)
        mixed = (1 - SHARED) * share + SHARED * both + 1e-3 * base / base.sum()
        self.probability = mixed / mixed.sum(axis=0)

    def word_scores(self, words: list[bytes]) -> np.ndarray:
        """Log-probability (scaled by length, alike for all languages) of each word in each language."""
        table = self.table()
        out = np.zeros((len(words), len(self.languages)))
        order = np.argsort([len(w) for w in words], kind="stable")
        for at in range(0, len(words), TOGETHER):
            some = order[at : at + TOGETHER]
            lattice = Lattice(self.pieces, [words[i] for i in some.tolist()])
            out[some] = np.log(lattice.totals(lattice.forward(table)))
        return out


class Scorer:
    """Scores texts; words that were met before are looked up in a bounded cache."""

    def __init__(self, model: Model, limit: int = CACHE):
        self.model, self.limit = model, limit
        self._clear()

    def _clear(self) -> None:
        self.at: dict[str, int] = {}
        self.rows = np.zeros((1024, len(self.model.languages)))

    def __call__(self, texts: list[str]) -> list[tuple[np.ndarray, int] | None]:
        """Sum of (scaled) log-probabilities of each text for each language, and how many letters it has; None: no letter."""
        words = [WORD.findall(t.lower()) for t in texts]
        missing = list(set().union(*words).difference(self.at)) if words else []
        if missing:
            if len(self.at) + len(missing) > self.limit:
                self._clear()
                missing = list(set().union(*words))
            start = len(self.at)
            if start + len(missing) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros((start + 2 * len(missing), self.rows.shape[1]))])
            self.rows[start : start + len(missing)] = self.model.word_scores([b" " + w.encode("utf-8", "replace") for w in missing])
            self.at.update(zip(missing, range(start, start + len(missing)), strict=True))
        out: list[tuple[np.ndarray, int] | None] = []
        for w in words:
            # The pattern also admits numerals that are no letters.
            if not any(c.isalpha() for x in w for c in x):
                out.append(None)
            else:
                out.append((self.rows[np.fromiter(map(self.at.__getitem__, w), dtype=np.int64, count=len(w))].sum(axis=0), sum(map(len, w))))
        return out


def posterior(scores: np.ndarray) -> tuple[int, float]:
    top = int(np.argmax(scores))
    return top, float(1 / np.exp(scores - scores[top]).sum())


def sample(docs: DataFrame, learn: Column, limit: int = SAMPLE_BYTES) -> pd.DataFrame:
    """(lang, text) of a sample of rows that may be learnt from: at most `limit` bytes.

    Languages get equal parts of the limit.  Each takes its texts that have a letter in
    the order of a hash of them, equal ones once, until its part is full; of a text it
    takes the first bytes, a LEAST-th of the part at most, so LEAST texts always fit.
    The order depends on the texts only, so it is the same for every run and partitioning."""
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text", F.xxhash64("text", F.lit(17)).alias("h"))
    texts = written(rows.groupBy("lang", "h").agg(F.min(F.octet_length("text")).alias("bytes")))
    sizes = {r["lang"]: r for r in texts.groupBy("lang").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")).collect()}
    if not sizes:
        return pd.DataFrame({"lang": [], "text": []})
    each = limit / len(sizes)
    longest = max(1, int(each / LEAST))

    def by_lang(values: dict[str, int]) -> Column:
        return F.create_map(*(F.lit(x) for item in values.items() for x in item))[F.col("lang")]

    # The last hash that each language takes; its share of the texts grows until that is among them.
    last: dict[str, int] = {}
    rate = {lang: 2 * max(each / max(r["bytes"], 1), LEAST / r["n"]) for lang, r in sizes.items()}
    while rate:
        below = by_lang({lang: min(2**63 - 1, int(x * 2**64) - 2**63) for lang, x in rate.items()})
        found = texts.where(F.col("h") <= below).select("lang", "h", F.least("bytes", F.lit(longest)).alias("bytes")).toPandas().sort_values(["lang", "h"])
        for lang, one in found.groupby("lang"):
            filled = one["bytes"].cumsum() + longest > each
            if filled.any() or rate[lang] >= 1:
                last[lang] = int(one["h"][filled.idxmax()] if filled.any() else one["h"].iloc[-1])
        rate = {lang: 4 * x for lang, x in rate.items() if lang not in last}
    taken = rows.where(F.col("h") <= by_lang(last)).groupBy("lang", "h").agg(F.min("text").alias("text"))
    # What comes before the first letter is left out, so that a cut text has one.
    begun = F.regexp_replace("text", r"^\P{L}+", "")
    out = taken.select("lang", F.substring(begun, 1, longest).alias("text")).toPandas()
    out["text"] = [t.encode("utf-8", "replace")[:longest].decode("utf-8", "ignore") or t[:1] for t in out["text"]]
    return out


def train(docs: DataFrame, learn: Column, vocabulary: str, limit: int = SAMPLE_BYTES) -> Model:
    """A model from the rows of (text, lang) for which `learn` holds."""
    found = sample(docs, learn, limit)
    counts: dict[str, dict[bytes, int]] = {}
    for lang, text in found.sort_values(["lang", "text"]).itertuples(index=False):
        have = counts.setdefault(lang, {})
        for word in WORD.findall(text.lower()):
            key = b" " + word.encode("utf-8", "replace")
            have[key] = have.get(key, 0) + 1
    counts = {k: v for k, v in counts.items() if v}
    languages = sorted(counts)
    model = Model(list(read_ranks(vocabulary)), languages)
    if languages:
        model.fit([counts[k] for k in languages])
    return model


def predict(docs: DataFrame, model: Model, columns: list[str], text_col: str = "text", added: tuple[str, str, str] = ("lang_pred", "score", "margin")) -> DataFrame:
    """docs' columns with lang_pred, its probability, and its margin; only the text is looked at.

    The margin is by how much the text's log-probability in that language exceeds that of
    letters drawn from SCALE ones, for each letter; null where the text is `und`."""
    model_sent = sent(docs.sparkSession, model)
    names = [c for c in columns if c != text_col]

    def run(batches):
        import pyarrow as pa

        scorer, languages = kept_in_worker(("langid", model_sent), lambda: Scorer(model_sent.value)), model_sent.value.languages
        for batch in batches:
            for part in parts(batch, batch.num_columns - 1):
                langs, scores, margins = [], [], []
                for found in scorer([t or "" for t in part.column(part.num_columns - 1).to_pylist()]) if languages else [None] * part.num_rows:
                    top, score = (None, 0.0) if found is None else posterior(found[0])
                    langs.append("und" if top is None else languages[top])
                    scores.append(score)
                    margins.append(None if top is None else float(found[0][top]) / found[1])
                kept = range(part.num_columns if text_col in columns else part.num_columns - 1)
                new = (pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(margins, pa.float64()))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), *new], names=[*(part.schema.names[i] for i in kept), *added])

    given = docs.select(*(F.col(f"`{c}`") for c in [*names, text_col]))
    kept = given.schema.fields if text_col in columns else given.schema.fields[:-1]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"`{added[0]}` string", f"`{added[1]}` double", f"`{added[2]}` double"])
    return given.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows of the fold that nothing is learnt from; a null id belongs to no fold."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))
