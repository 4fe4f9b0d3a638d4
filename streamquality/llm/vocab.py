"""Encoding with a byte-level vocabulary of the tokenizers library."""

from __future__ import annotations

import json
import os
import re
from collections import namedtuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, held
from .pieces import PieceEncoder

#: The file's text goes to the workers with the closure: its size is fixed.
Vocabulary = namedtuple("Vocabulary", "json pattern size")


def read_vocabulary(path: str, pattern: str) -> Vocabulary:
    """``pattern`` is the split that the file's byte-level step makes."""
    from tokenizers import Tokenizer
    with open(path) as f:
        text = f.read()
    return Vocabulary(text, pattern, Tokenizer.from_str(text).get_vocab_size())


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 stands
    for itself, the others get the letters from 256 on in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class AddedTokens:
    """The tokens that a vocabulary file adds to its model's: the library takes them out of a text,
    leftmost and longest first, before the split. Of tokens with further conditions (whole words,
    white space beside them) the library itself decides."""

    def __init__(self, vocabulary: Vocabulary):
        added = [a for a in json.loads(vocabulary.json).get("added_tokens") or [] if a["content"]]
        self.ids = {a["content"]: np.array([a["id"]], np.uint32) for a in added}
        self.plain = not any(a.get(flag) for a in added for flag in ("single_word", "lstrip", "rstrip"))
        self.cut = re.compile("(%s)" % "|".join(map(re.escape, sorted(self.ids, key=len, reverse=True)))).split
        self.json = vocabulary.json

    def holders(self, texts: pa.Array) -> list[int]:
        """Places of the texts that contain one."""
        found = [np.flatnonzero(pc.fill_null(pc.match_substring(texts, t), False).to_numpy(zero_copy_only=False)) for t in self.ids]
        return sorted(set(np.concatenate(found).tolist())) if found else []

    def encode(self, text: str, encoder: PieceEncoder) -> np.ndarray:
        if not self.plain:
            from tokenizers import Tokenizer
            return np.array(Tokenizer.from_str(self.json).encode(text, add_special_tokens=False).ids, np.uint32)
        return np.concatenate([self.ids[part] if k % 2 else encoder.encode(part) for k, part in enumerate(self.cut(text))])


def _encoder(vocabulary: Vocabulary) -> PieceEncoder:
    def make():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        model = Tokenizer.from_str(vocabulary.json).model
        letters = byte_letters()
        def piece_ids(piece: str) -> list[int]:
            if piece.isascii() and piece.isprintable():  # only the space has a letter other than itself
                spelt = piece.replace(" ", letters[32])
            else:
                spelt = "".join([letters[b] for b in piece.encode()])
            return [t.id for t in model.tokenize(spelt)]
        return PieceEncoder(vocabulary.pattern, piece_ids, limit=600_000)
    return held((__name__, hash(vocabulary)), make)


def encode(df: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text",
           end: int | None = None) -> DataFrame:
    """``key, ids array<int>`` in the order of the rows; ``end`` is appended to each document.
    The library's model encodes each piece of the split; added tokens of the vocabulary file that
    stand in a text get their own ids, as in the library. A null text counts as empty; repeated rows stay repeated; other columns are not read."""
    added = AddedTokens(vocabulary)
    tail = np.array([] if end is None else [end], np.uint32)
    def run(batch):
        encoder = _encoder(vocabulary)
        texts = [t or "" for t in batch.column("t").to_pylist()]
        whole = {i: texts[i] for i in added.holders(batch.column("t"))}
        for i in whole:
            texts[i] = ""
        encoded = encoder.encode_all(texts)
        for i, text in whole.items():
            encoded[i] = added.encode(text, encoder)
        arrays = [x for ids in encoded for x in (ids, tail)]
        sizes = [len(a) + len(tail) for a in arrays[::2]]
        offsets = np.zeros(len(sizes) + 1, np.int32)
        np.cumsum(sizes, out=offsets[1:])
        ids = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(arrays).astype(np.int32)))
        return pa.RecordBatch.from_arrays([batch.column("k"), ids], ["k", "ids"])
    rows = arrow_map(df.select(F.col(key).alias("k"), F.col(text).alias("t")), run,
                     f"k {df.schema[key].dataType.simpleString()}, ids array<int>", "t", lambda: None)  # the worker's next task goes on with what is remembered, 120 MB at most
    return rows.withColumnRenamed("k", key)
