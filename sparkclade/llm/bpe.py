"""Byte-level BPE encoding and decoding.

Encoding: the merges are compiled into a finite-state transducer that is
determinised lazily.  After each byte the encoding of what has been read so far is
known: it ends in the one token that is a suffix of the input, encodes to itself
and may follow the last token before it (two tokens may follow each other if their
bytes together encode to just the two).  A state holds the boundaries from which
some token can still reach past the current byte, each with the last token before
it.  Tokens that the encodings up to all these boundaries share are emitted.  The
lookahead is bounded by the longest token, and a run of any length takes linear
time and constant memory.  Many short pieces go through the transducer side by side,
a byte of each at a time; moves that are known are looked up for all of them at once.

Decoding: ids become bytes by table; an incremental UTF-8 state machine gives out
text as soon as a code point is complete.

A null text counts as empty and has no ids; repeated and tied rows get equal results,
as rows are independent of each other; an empty table gives an empty result.  Columns
other than id and text are not read, so their names don't matter.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkclade.llm.common import kept

#: Entries that the caches of a Python worker may hold: some 100 MB.
CACHE = 300_000
STATES = 250_000
_NEVER = 1 << 60
#: Above every id plus one.
_IDS = 1 << 24
#: Bytes of one piece between which tokens are given out.
LOOK = 512
#: Bytes of text that are looked up together.
GROUP = 1 << 20
#: Longer pieces go through the transducer alone.
SHORT = 64


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Moves:
    """(state, byte) to state, by open addressing, so that many are looked up at once."""

    def __init__(self, bits: int = 12):
        self.bits, self.count = bits, 0
        self.keys, self.to = np.full(1 << bits, -1, dtype=np.int64), np.zeros(1 << bits, dtype=np.int64)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The next states; -1: not known."""
        out, rest, at, last = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys)), self._place(keys), len(self.keys) - 1
        while len(rest):
            held = self.keys[at]
            same = held == keys[rest]
            out[rest[same]] = self.to[at[same]]
            further = ~same & (held >= 0)
            rest, at = rest[further], (at[further] + 1) & last
        return out

    def add(self, keys: np.ndarray, to: np.ndarray) -> None:
        """keys: distinct, and none of them known."""
        if 2 * (self.count + len(keys)) > len(self.keys):
            old = self.keys >= 0
            keys, to = np.concatenate([self.keys[old], keys]), np.concatenate([self.to[old], to])
            self.__init__(max(12, (4 * len(keys)).bit_length()))
        at, last = self._place(keys), len(self.keys) - 1
        self.count += len(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[at] < 0)
            # Of those that want one place the first has it.
            free = free[np.unique(at[free], return_index=True)[1]]
            self.keys[at[free]], self.to[at[free]] = keys[free], to[free]
            rest = np.ones(len(keys), dtype=bool)
            rest[free] = False
            keys, to, at = keys[rest], to[rest], (at[rest] + 1) & last


class Transducer:
    """Encodes pieces (matches of the splitting pattern)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        # A trie of the tokens: child[node << 8 | byte], the token that ends at a node, and whether it goes on.
        self.child: dict[int, int] = {}
        self.token: list[bytes | int | None] = [None]
        self.inner, self.depth = [True], [0]
        self.width = {v: len(k) for k, v in ranks.items()}
        self.widths = np.zeros(max(ranks.values(), default=0) + 1, dtype=np.int64)
        self.widths[list(self.width)] = list(self.width.values())
        for t in ranks:
            node = 0
            for k, byte in enumerate(t):
                self.inner[node] = True
                node = self.child.setdefault(node << 8 | byte, len(self.token))
                if node == len(self.token):
                    self.token.append(None)
                    self.inner.append(False)
                    self.depth.append(k + 1)
            self.token[node] = t
        self.pairs: dict[tuple[int, int], bool] = {}
        self.made_of: dict[bytes, tuple[bytes, bytes] | None] = {}
        self.edges: dict[tuple[bytes, int], list[tuple[bytes, int, int]]] = {}
        self._reset()

    def _reset(self) -> None:
        self.ids = {(0,): 0}
        self.states: list[tuple[int, ...]] = [(0,)]
        self.moves: dict[int, int] = {}
        self.many = Moves()
        #: The last token of the encoding of what has been read.
        self.tails = [-1]

    def merge(self, piece: bytes) -> list[int]:
        """The encoding by its definition; used on a token's bytes when it is first met."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        self.last_merge = None
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], _NEVER))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            self.last_merge = parts[best], parts[best + 1]
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.ranks[p] for p in parts]

    def halves(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two tokens whose merge makes this one; None for a byte, or where merges never make it."""
        if token not in self.made_of:
            whole = self.merge(token) == [self.ranks[token]]
            self.made_of[token] = self.last_merge if whole else None
        return self.made_of[token]

    def is_proper(self, token: bytes) -> bool:
        return len(token) == 1 or self.halves(token) is not None

    def edge(self, token: bytes, side: int) -> list[tuple[bytes, int, int]]:
        """The tokens that stand at one edge while this one is made, each with the ranks of
        the merges that make it and that take it up (for the token itself: never)."""
        if (token, side) not in self.edges:
            found, end = [], _NEVER
            while token:
                halves = self.halves(token)
                found.append((token, self.ranks[token] if halves else -1, end))
                end = self.ranks[token]
                token = halves[side] if halves else b""
            self.edges[found[0][0], side] = found
            return found
        return self.edges[token, side]

    def may_follow(self, a: int, b: int) -> bool:
        """No merge across the boundary comes before those inside: of equal ranks the left one does."""
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) >= CACHE:
                self.pairs.clear()
            ranks, right = self.ranks, self.edge(self.bytes_of[b], 0)
            found = True
            for x, x_from, x_to in self.edge(self.bytes_of[a], 1):
                for y, y_from, y_to in right:
                    if x_from < y_to and y_from <= x_to:
                        r = ranks.get(x + y, _NEVER)
                        if r < x_to and r <= y_to and r != _NEVER:
                            found = False
            self.pairs[a, b] = found
        return found

    def _ends_here(self, node: int) -> int:
        """The id of the token at a node, -1 if there is none that merges make; then kept."""
        token = self.token[node]
        if token.__class__ is not int:
            token = self.token[node] = self.ranks[token] if token is not None and self.is_proper(token) else -1
        return token

    def _move(self, state: int, byte: int) -> int:
        """The next state, made when it is first needed.

        A state lists the boundaries from which a token can still reach on: for each the
        trie node of the bytes since, and the last token before it (plus one; 0: none)."""
        child, inner, reach, here = self.child, self.inner, [], -1
        for code in self.states[state]:
            node, before = divmod(code, _IDS)
            to = child.get(node << 8 | byte)
            if to is None:
                continue
            if here < 0:
                token = self._ends_here(to)
                if token >= 0 and (not before or self.may_follow(before - 1, token)):
                    here = token
            if inner[to]:
                reach.append(to * _IDS + before)
        reach.append(here + 1)
        key = tuple(reach)
        found = self.ids.get(key)
        if found is None:
            found = self.ids[key] = len(self.states)
            self.states.append(key)
            self.tails.append(here)
        self.moves[state << 8 | byte] = found
        return found

    def encode(self, piece: bytes) -> list[int]:
        if piece in self.ranks:
            return [self.ranks[piece]]
        return [i for some in self.stream((piece[k : k + LOOK] for k in range(0, len(piece), LOOK))) for i in some]

    def encode_all(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, one after the other, and how many each has."""
        whole = np.fromiter((self.ranks.get(p, -1) for p in pieces), dtype=np.int64, count=len(pieces))
        size = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        count = (whole >= 0).astype(np.int64)
        alone = {i: self.encode(pieces[i]) for i in np.flatnonzero((whole < 0) & (size > SHORT)).tolist()}
        for i, ids in alone.items():
            count[i] = len(ids)
        rest = np.flatnonzero((whole < 0) & (size > 0) & (size <= SHORT))
        rest = rest[np.argsort(-size[rest], kind="stable")]
        found = self._side_by_side([pieces[i] for i in rest.tolist()], size[rest])
        for step, (some, _) in enumerate(found):
            count[rest[some]] = step + 1
        end = np.cumsum(count)
        out = np.zeros(int(end[-1]) if len(end) else 0, dtype="<u4")
        out[end[whole >= 0] - 1] = whole[whole >= 0]
        for step, (some, ids) in enumerate(found):
            out[end[rest[some]] - 1 - step] = ids
        for i, ids in alone.items():
            out[end[i] - len(ids) : end[i]] = ids
        return out, count

    def _side_by_side(self, pieces: list[bytes], size: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For the last token of each, the one before it and so on: which pieces have one, and its id.

        The pieces come by falling length."""
        if not pieces:
            return []
        if len(self.states) > STATES:
            self._reset()
        width = int(size[0])
        text = np.frombuffer(b"".join([p.ljust(width, b"\0") for p in pieces]), dtype=np.uint8).reshape(len(pieces), width).T.astype(np.int64)
        state, ends, tails = np.zeros(len(pieces), dtype=np.int64), np.zeros((width, len(pieces)), dtype=np.int64), np.array(self.tails)
        still = np.searchsorted(-size, -np.arange(width), side="left")
        for j, n in enumerate(still.tolist()):
            key = state[:n] << 8 | text[j, :n]
            to = self.many.find(key)
            unknown = np.flatnonzero(to < 0)
            if len(unknown):
                keys, back = np.unique(key[unknown], return_inverse=True)
                made = np.array([self.moves[k] if k in self.moves else self._move(k >> 8, k & 255) for k in keys.tolist()])
                self.many.add(keys, made)
                to[unknown] = made[back]
                tails = np.concatenate([tails, self.tails[len(tails) :]]).astype(np.int64)
            state[:n] = to
            ends[j, :n] = tails[to]
        out, at, left = [], np.arange(len(pieces)), size.copy()
        while len(at):
            ids = ends[left - 1, at]
            out.append((at, ids))
            left = left - self.widths[ids]
            at, left = at[left > 0], left[left > 0]
        return out

    def stream(self, blocks: Iterable[bytes]) -> Iterator[list[int]]:
        """Ids of one piece that comes in blocks: what no later byte can change is given out after each."""
        if len(self.states) > STATES:
            self._reset()
        known, tails = self.moves.get, self.tails
        state, ends = 0, []  # ends: the last token at each byte since what has been given out
        first = True
        for block in blocks:
            if not first:
                settled, ends = self._settled(state, ends)
                yield settled
            first = False
            for byte in block:
                to = known(state << 8 | byte)
                state = self._move(state, byte) if to is None else to
                ends.append(tails[state])
        yield self._chain(ends, len(ends))

    def _chain(self, ends: list[int], to: int) -> list[int]:
        out = []
        while to > 0:
            out.append(ends[to - 1])
            to -= self.width[out[-1]]
        return out[::-1]

    def _settled(self, state: int, ends: list[int]) -> tuple[list[int], list[int]]:
        """Tokens that the encodings up to all open boundaries begin with, and the ends after them."""
        common = None
        for code in self.states[state]:
            to = len(ends) - self.depth[code // _IDS]
            passed = {to}
            while to > 0:
                to -= self.width[ends[to - 1]]
                passed.add(to)
            common = passed if common is None else common & passed
        at = max(common)
        return self._chain(ends, at), ends[at:]


class Utf8Decoder:
    """Incremental UTF-8: feed bytes, get the text that is complete; finish() flushes.

    Ill-formed bytes become U+FFFD, one for each maximal part, as in the standard."""

    def __init__(self) -> None:
        self.need, self.low, self.high, self.held = 0, 0x80, 0xBF, b""

    def feed(self, data: bytes) -> str:
        if not self.need and data.isascii():
            return data.decode("ascii")
        run: list[int] = []
        for byte in data:
            if self.need:
                if self.low <= byte <= self.high:
                    self.held += bytes((byte,))
                    self.need -= 1
                    self.low, self.high = 0x80, 0xBF
                    if not self.need:
                        run.append(_code_point(self.held))
                        self.held = b""
                    continue
                run.append(0xFFFD)
                self.need, self.low, self.high, self.held = 0, 0x80, 0xBF, b""
            if byte < 0x80:
                run.append(byte)
            elif 0xC2 <= byte <= 0xF4:
                self.need = 1 + (byte >= 0xE0) + (byte >= 0xF0)
                self.low = {0xE0: 0xA0, 0xF0: 0x90}.get(byte, 0x80)
                self.high = {0xED: 0x9F, 0xF4: 0x8F}.get(byte, 0xBF)
                self.held = bytes((byte,))
            else:
                run.append(0xFFFD)
        return "".join(map(chr, run))

    def finish(self) -> str:
        rest = "�" if self.need else ""
        self.need, self.held, self.low, self.high = 0, b"", 0x80, 0xBF
        return rest


def _code_point(held: bytes) -> int:
    value = held[0] & (0xFF >> (len(held) + 1))
    for byte in held[1:]:
        value = value << 6 | byte & 0x3F
    return value


class Decoder:
    """ids to bytes, and to text as it becomes complete.

    For a token that is met where no code point is open and that leaves none open, the
    state machine's answer is kept; other tokens are stepped through byte by byte."""

    def __init__(self, ranks: dict[bytes, int]):
        self.table = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            self.table[i] = token
        self.whole: dict[int, str | None] = {}

    def to_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join([self.table[i] for i in ids])

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        machine = Utf8Decoder()
        for i in ids:
            if machine.need:
                text = machine.feed(self.table[i])
            else:
                text = self.whole.get(i)
                if text is None:
                    text = machine.feed(self.table[i])
                    if not machine.need:
                        self.whole[i] = text
            if text:
                yield text
        if rest := machine.finish():
            yield rest


_BEFORE_WORD = re.compile(r"(?= \S)")
_ODD_SPACE = re.compile(r" (?=\s)")


def word_chunks(text: str) -> list[str]:
    """text cut before each space that a non-space follows.

    Byte-level BPE patterns always begin a match there and never look across, so chunks
    can be encoded apart."""
    if _ODD_SPACE.search(text) or text.startswith(" "):
        return [c for c in _BEFORE_WORD.split(text) if c]
    first, *rest = text.split(" ")
    if rest and not rest[-1]:
        return [c for c in _BEFORE_WORD.split(text) if c]
    return [first, *[" " + w for w in rest]] if first else []


class ChunkCoder:
    """Encodes texts chunk by chunk; repeated chunks are looked up in a bounded cache."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], limit: int = CACHE):
        self.encode, self.limit, self.known = encode, limit, {}

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        cuts = [word_chunks(t) for t in texts]
        missing = list(set().union(*cuts).difference(self.known))
        if missing:
            if len(self.known) + len(missing) > self.limit:
                self.known.clear()
                missing = list(set().union(*cuts))
            self.known.update(zip(missing, self.encode(missing), strict=True))
        known = self.known
        return [b"".join([known[c] for c in cut]) for cut in cuts]


def coder(path: str, pattern: str) -> tuple[ChunkCoder, Decoder]:
    """Made once in a Python worker."""

    def make() -> tuple[ChunkCoder, Decoder]:
        import regex

        ranks = read_ranks(path)
        machine, split = Transducer(ranks), regex.compile(pattern)

        def encode(chunks: list[str]) -> list[bytes]:
            cuts = [split.findall(c) for c in chunks]
            ids, count = machine.encode_all([p.encode() for cut in cuts for p in cut])
            ends = np.concatenate(([0], 4 * np.cumsum(count)))[np.cumsum([0, *map(len, cuts)])].tolist()
            raw = ids.tobytes()
            return [raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

        return ChunkCoder(encode), Decoder(ranks)

    return kept(("bpe", path, pattern), make)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids binary little-endian uint32, decoded string) of every whole text."""

    def run(batches):
        code, decoder = coder(path, pattern)
        for batch in batches:
            for part in parts(batch, 1):
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids = code(texts)
                decoded = ["".join(decoder.stream(np.frombuffer(x, dtype="<u4").tolist())) for x in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], names=[id_col, "n_tokens", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, n_tokens bigint, ids binary, decoded string")


def parts(batch: pa.RecordBatch, column: int, limit: int = GROUP) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose values in a string column have about `limit` bytes together."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    begin = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += n
    if begin < batch.num_rows:
        yield batch.slice(begin)


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode(), with digests of the ids, and of the decoded text's bytes, in place of these themselves."""
    return encode(docs, path, pattern, id_col, text_col).select(id_col, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
