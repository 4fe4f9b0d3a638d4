"""Byte-level BPE by a transducer: encoding emits tokens after bounded lookahead, decoding
streams text through a UTF-8 state machine.

Any token may be under way at any byte, so the machine that spells tokens is non-deterministic;
its deterministic states are the sets of tokens under way, which the longest of their spelt parts
names. States and transitions are made when first met and kept in bounded tables (lazy
determinising). A token sequence is what the merges give exactly if every two neighbours stay
apart when merged together, and of the tokens that end at a byte just one fits what came before:
a state's outputs are tried against the token that ends where they begin. A boundary is settled
when every token under way begins behind it; so no more than a few token lengths are held.
"""

from __future__ import annotations

import base64
import hashlib
from collections import namedtuple
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, held
from .pieces import PieceEncoder

#: Compiled merges: bytes of each token, and the two tokens that its last merge joined.
Merges = namedtuple("Merges", "pattern tokens left right")


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of the token, a space, its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int], below: int | None = None) -> list[bytes]:
    """The merges, done one by one: lowest rank first, leftmost of equals; ranks ``below`` only."""
    parts = [piece[i:i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = min((ranks.get(a + b, 1 << 31), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if best >= (1 << 31 if below is None else below):
            break
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return parts


@lru_cache(maxsize=4)
def compile_merges(path: str, pattern: str) -> Merges:
    """From a rank file. Small and of fixed size, so tasks get it with their closure."""
    ranks = read_ranks(path)
    n = max(ranks.values()) + 1
    tokens, left, right = [b""] * n, [-1] * n, [-1] * n
    for token, rank in ranks.items():
        tokens[rank] = token
        if len(token) > 1:
            parts = merge(token, ranks, rank)
            if len(parts) == 2:  # else no merges lead to it: only a whole piece is encoded as it
                left[rank], right[rank] = ranks[parts[0]], ranks[parts[1]]
    return Merges(pattern, tokens, np.array(left, np.int32), np.array(right, np.int32))


class Transducer:
    """Ids of one piece. ``limit`` bounds the transitions and the pairs that are remembered;
    ``held`` the bytes after which settled tokens are emitted."""

    def __init__(self, merges: Merges, limit: int = 150_000, held: int = 4096):
        self.tokens, self.limit, self.held = merges.tokens, limit, held
        self.left, self.right = merges.left.tolist(), merges.right.tolist()
        self.rank = {t: i for i, t in enumerate(merges.tokens) if t}
        self.reached = {t: i for t, i in self.rank.items() if len(t) == 1 or self.left[i] >= 0}
        self.spelt = {t[:k] for t in self.reached for k in range(1, len(t) + 1)}
        self.pairs: dict[int, bool] = {}
        self._reset(b"")

    def _reset(self, at: bytes) -> None:
        self.states = {at: 0}
        self.names = [at]
        self.outputs = [self._ending(at)]
        self.step: dict[int, int] = {}

    def forget(self) -> None:
        self._reset(b"")
        self.pairs.clear()

    def _ending(self, name: bytes) -> list[tuple[int, int]]:
        """Length and id of the tokens that end here, longest first."""
        ends = (name[k:] for k in range(len(name)))
        return [(len(t), self.reached[t]) for t in ends if t in self.reached]

    def _move(self, state: int, byte: int) -> int:
        if len(self.step) >= self.limit:
            self._reset(self.names[state])
            state = 0
        name = self.names[state] + bytes((byte,))
        while name not in self.spelt:
            name = name[1:]
        target = self.states.get(name)
        if target is None:
            target = self.states[name] = len(self.names)
            self.names.append(name)
            self.outputs.append(self._ending(name))
        self.step[state << 8 | byte] = target
        return target

    def apart(self, a: int, b: int) -> bool:
        """Whether ``a b`` stays two tokens. Looks at the merges across the border in the order
        in which they would come: undo whichever side's last merge came later, and see whether
        what faced each other before would have been joined first. Of equal merges the left one
        comes first, so the right side loses ties."""
        x, y, deadline = a, b, 1 << 31
        while True:
            joined = self.rank.get(self.tokens[x] + self.tokens[y])
            if joined is not None and joined < deadline and self.left[joined] >= 0:
                return False
            if self.left[x] < 0 and self.left[y] < 0:
                return True
            if self.left[y] < 0 or (self.left[x] >= 0 and x > y):
                x, deadline = self.right[x], x
            else:
                y, deadline = self.left[y], y + 1

    def _fits(self, key: int) -> bool:
        if len(self.pairs) >= self.limit:
            self.pairs.clear()
        answer = self.pairs[key] = self.apart(key >> 32, key & 0xFFFFFFFF)
        return answer

    def _path(self, last: list[int], n: int, stop: int = 0) -> list[int]:
        out = []
        while n > stop:
            out.append(last[n])
            n -= len(self.tokens[last[n]])
        return out[::-1]

    def _settled(self, last: list[int], depth: int) -> int:
        """The boundary that all paths still open have in common."""
        fronts = set(range(len(last) - 1 - depth, len(last)))
        while len(fronts) > 1:
            far = max(fronts)
            fronts.discard(far)
            fronts.add(far - len(self.tokens[last[far]]))
        return fronts.pop()

    def encode(self, piece: bytes) -> list[int]:
        whole = self.rank.get(piece)
        if whole is not None:
            return [whole]
        out: list[int] = []
        last = [-1]  # by length read: the token that ends there
        state, n, pairs = 0, 0, self.pairs
        if self.names[0]:
            self._reset(b"")
        step, outputs = self.step, self.outputs
        for byte in piece:
            n += 1
            move = step.get(state << 8 | byte)
            if move is None:
                move = self._move(state, byte)
                step, outputs = self.step, self.outputs
            state = move
            for size, token in outputs[state]:
                before = last[n - size] if size <= n else -2
                if before == -1:
                    break
                if before >= 0:
                    key = before << 32 | token
                    fits = pairs.get(key)
                    if self._fits(key) if fits is None else fits:
                        break
            last.append(token)
            if n >= self.held:
                cut = self._settled(last, min(n, len(self.names[state])))
                if cut:
                    out += self._path(last, cut)
                    last = last[cut:]
                    n -= cut
        return out + self._path(last, n)


class Utf8Machine:
    """Bytes in, characters out as soon as they are whole. The state is what may follow: how many
    continuation bytes are due and the bounds of the next one. Bytes that can't be part of a
    character become U+FFFD."""

    #: first byte from, to -> continuation bytes due, bounds of the next (fixed values: RFC 3629)
    LEADS = [(0xC2, 0xDF, 1, 0x80, 0xBF), (0xE0, 0xE0, 2, 0xA0, 0xBF), (0xE1, 0xEC, 2, 0x80, 0xBF),
             (0xED, 0xED, 2, 0x80, 0x9F), (0xEE, 0xEF, 2, 0x80, 0xBF), (0xF0, 0xF0, 3, 0x90, 0xBF),
             (0xF1, 0xF3, 3, 0x80, 0xBF), (0xF4, 0xF4, 3, 0x80, 0x8F)]
    LEAD = {b: (due, lo, hi) for first, last, due, lo, hi in LEADS for b in range(first, last + 1)}

    def __init__(self) -> None:
        self.due, self.lo, self.hi, self.held = 0, 0x80, 0xBF, b""

    def feed(self, data: bytes) -> str:
        if not self.due and data.isascii():
            return data.decode("ascii")
        out = []
        for b in data:
            if self.due and self.lo <= b <= self.hi:
                self.due, self.lo, self.hi, self.held = self.due - 1, 0x80, 0xBF, self.held + bytes([b])
                if not self.due:
                    out.append(self.held.decode())
                continue
            if self.due:
                out.append("�")
            self.due, self.lo, self.hi = self.LEAD.get(b, (0, 0x80, 0xBF))
            self.held = bytes([b])
            if not self.due:
                out.append(chr(b) if b < 0x80 else "�")
        return "".join(out)

    def end(self) -> str:
        cut, self.due = "�" * bool(self.due), 0
        return cut


class Codec:
    """Encoder and decoder of one vocabulary, made once in a worker."""

    def __init__(self, merges: Merges):
        machine = Transducer(merges)
        self.encoder = PieceEncoder(merges.pattern, lambda piece: machine.encode(piece.encode()))
        self.tokens = merges.tokens
        self.machine = machine
        self.texts: list[str | None] = []
        for token in merges.tokens:
            m = Utf8Machine()
            text = m.feed(token)
            self.texts.append(None if m.due or "�" in text and "�".encode() not in token else text)
        self.whole = np.array([t is not None for t in self.texts])

    def forget(self) -> None:
        """Frees what was remembered of the texts."""
        self.encoder.forget()
        self.machine.forget()

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids. Tokens of whole characters pass as they are; only runs of tokens that
        hold parts of characters go through the machine."""
        machine, out, texts = Utf8Machine(), [], self.texts
        split = np.flatnonzero(~self.whole[ids]).tolist()
        ids = ids.tolist()
        done = 0
        for i in split:
            if i < done:
                continue
            out += map(texts.__getitem__, ids[done:i])
            while i < len(ids) and (machine.due or texts[ids[i]] is None):
                out.append(machine.feed(self.tokens[ids[i]]))
                i += 1
            done = i
        out += map(texts.__getitem__, ids[done:])
        out.append(machine.end())
        return "".join(out)


def codec(merges: Merges) -> Codec:
    return held((__name__, merges.pattern, hash(tuple(merges.tokens))), lambda: Codec(merges))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    values = np.concatenate(arrays) if arrays else np.zeros(0)
    return pa.ListArray.from_arrays(offsets, pa.array(values.astype(np.int32)))


def _key_type(df: DataFrame, key: str) -> str:
    return df.schema[key].dataType.simpleString()


def encode(df: DataFrame, merges: Merges, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, ids array<int>`` of every row: each match of the pattern encoded separately, without
    special tokens. A null text counts as empty and gives an empty array; rows are neither
    dropped nor merged (repeated rows stay repeated), other columns are not looked at. Texts of
    any length are read in bounded parts."""
    def run(batch):
        ids = codec(merges).encoder.encode_all([t or "" for t in batch.column("t").to_pylist()])
        return pa.RecordBatch.from_arrays([batch.column("k"), _lists(ids)], ["k", "ids"])
    rows = arrow_map(df.select(df[key].alias("k"), df[text].alias("t")), run,
                     f"k {_key_type(df, key)}, ids array<int>", "t", lambda: codec(merges).forget())
    return rows.withColumnRenamed("k", key)


def decode(df: DataFrame, merges: Merges, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key, text`` of every row of ids; null ids count as none. Bytes that are no UTF-8 become
    U+FFFD; ids outside the vocabulary fail the job."""
    def run(batch):
        texts = [codec(merges).decode(np.array(x or [], np.int64)) for x in batch.column("i").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("k"), pa.array(texts, pa.string())], ["k", "text"])
    def each(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                yield run(batch.slice(at, 500))
    rows = df.select(df[key].alias("k"), df[ids].alias("i")).mapInArrow(
        each, f"k {_key_type(df, key)}, text string")
    return rows.withColumnRenamed("k", key)


def round_trip(df: DataFrame, merges: Merges, key: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """``key, ids array<int>, text string``: :func:`encode`, then :func:`decode` of those ids, in
    one pass of the workers. Rows, nulls and long texts as there. With ``digest`` the last column
    is ``decoded_sha256`` instead, the hex SHA-256 of the decoded bytes, and the texts stay in the workers."""
    last = "decoded_sha256" if digest else "text"

    def run(batch):
        c = codec(merges)
        ids = c.encoder.encode_all([t or "" for t in batch.column("t").to_pylist()])
        texts = map(c.decode, ids)
        texts = [hashlib.sha256(t.encode()).hexdigest() for t in texts] if digest else list(texts)
        return pa.RecordBatch.from_arrays([batch.column("k"), _lists(ids), pa.array(texts, pa.string())], ["k", "ids", last])
    rows = arrow_map(df.select(df[key].alias("k"), df[text].alias("t")), run,
                     f"k {_key_type(df, key)}, ids array<int>, {last} string", "t", lambda: codec(merges).forget())
    return rows.withColumnRenamed("k", key)
