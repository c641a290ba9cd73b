"""Encoding with a public byte-level BPE vocabulary by dynamic programming over prefixes.

The text is split by the vocabulary's pattern; equal pieces are encoded once for each worker. For a piece, an Aho-Corasick
automaton over the vocabulary gives the tokens that end at every position. A sequence of tokens is what the merges would give
if and only if every adjacent pair is, so each prefix has one last token: the one that is compatible with the last token of the
prefix left of it. These last tokens are stored for all prefixes and the ids are read off along the back-pointers.

Defined cases
    Null and empty texts give an empty list. Strings that look like special tokens are ordinary text. Texts of any length and
    script are encoded whole; a piece without white space of any length takes time in proportion to its length.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from corpusmill.runtime import ship

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed value: the published pattern that splits texts for this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts that are ASCII only, for the faster module.
ASCII_PATTERN = PATTERN.replace(r"\p{L}", "a-zA-Z").replace(r"\p{N}", "0-9").replace(" ?a-zA-Z+", " ?[a-zA-Z]+").replace(" ?0-9+", " ?[0-9]+")
#: Pieces kept for each worker; beyond it the store starts anew, which changes no result.
KEPT_PIECES = 250_000


def byte_alphabet() -> dict[str, int]:
    """The published table of printable stand-ins for bytes, built from its rule: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixEncoder(dict):
    """Maps a piece of text to its tuple of ids."""

    def __init__(self, vocabulary: str = VOCABULARY):
        import ahocorasick
        import regex

        model = json.load(open(vocabulary, encoding="utf-8"))["model"]
        stand_in = byte_alphabet()
        raw = lambda token: bytes(stand_in[c] for c in token).decode("latin-1")
        ids = {t: i for t, i in model["vocab"].items() if all(c in stand_in for c in t)}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {(ids[a], ids[b]): k for k, (a, b) in enumerate(merges)}
        self.parts = {ids[a + b]: (ids[a], ids[b]) for a, b in merges}
        self.made = {ids[a + b]: k for k, (a, b) in enumerate(merges)}
        self.text = {i: raw(t) for t, i in ids.items() if i in self.parts or len(t) == 1}
        self.automaton = ahocorasick.Automaton()
        for i, s in self.text.items():
            self.automaton.add_word(s, (len(s), i))
        self.automaton.make_automaton()
        self.split_any, self.split_ascii = regex.compile(PATTERN).findall, re.compile(ASCII_PATTERN, re.ASCII).findall
        self.compatible = lru_cache(1 << 20)(self._compatible)
        self.alone = lru_cache(1 << 17)(self._alone)

    def spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens at an edge of `token`, from the whole token down to a byte, each with the rank at which it is merged away."""
        out, gone = [], float("inf")
        while True:
            out.append((token, gone))
            if token not in self.parts:
                return out
            gone = self.made[token]
            token = self.parts[token][side]

    def _compatible(self, left: int, right: int, limit: float = float("inf")) -> bool:
        """Whether no merge crosses the border of two tokens: one that comes before either neighbour is merged away.

        Of equal merges the leftmost comes first, so a tie counts against the left token's own merge only.
        """
        for x, x_gone in self.spine(left, 1):
            x_gone = min(x_gone, limit)
            for y, y_gone in self.spine(right, 0):
                made = self.rank.get((x, y))
                if made is not None and made < x_gone and made <= min(y_gone, limit):
                    return False
        return True

    def _alone(self, token: int) -> bool:
        """Whether the merges turn the bytes of a token into that token."""
        if token not in self.parts:
            return True
        a, b = self.parts[token]
        return self.alone(a) and self.alone(b) and self._compatible(a, b, self.made[token])

    def __missing__(self, piece: str) -> tuple[int, ...]:
        data = piece.encode("utf-8").decode("latin-1")
        last = [-1] * (len(data) + 1)
        size = [0] * (len(data) + 1)
        for at, (length, token) in self.automaton.iter(data):  # by end, the longest first; only one of an end's tokens fits
            end = at + 1
            if not size[end] and (self.alone(token) if end == length else self.compatible(last[end - length], token)):
                last[end], size[end] = token, length
        out, end = [], len(data)
        while end:
            out.append(last[end])
            end -= size[end]
        if len(self) >= KEPT_PIECES:
            self.clear()
        result = tuple(reversed(out))
        if len(piece) <= 64:
            self[piece] = result
        return result

    def split(self, text: str) -> list[str]:
        return (self.split_ascii if text.isascii() else self.split_any)(text)

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, self.split(text)))) if text else []


_encoders: dict[str, PrefixEncoder] = {}


def encoder(vocabulary: str = VOCABULARY) -> PrefixEncoder:
    """One encoder for each worker process and vocabulary."""
    if vocabulary not in _encoders:
        # an executor without the file at this path has the copy that the driver serves
        _encoders[vocabulary] = PrefixEncoder(vocabulary if os.path.exists(vocabulary) else SparkFiles.get(os.path.basename(vocabulary)))
    return _encoders[vocabulary]


def share(spark: SparkSession, vocabulary: str) -> None:
    """Let the driver serve the vocabulary file to executors that lack it."""
    if os.path.exists(vocabulary):
        spark.sparkContext.addFile(vocabulary)


def encode_documents(df: DataFrame, id_col: str, text_col: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Rows (id_col, ids ARRAY<INT>), one for each input row."""
    ship(df.sparkSession)
    share(df.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            flat: list[int] = []
            offsets = [0]
            for text in batch.column(1).to_pylist():
                if text:
                    flat.extend(chain.from_iterable(map(enc.__getitem__, enc.split(text))))
                offsets.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], [id_col, "ids"])

    kind = dict(df.dtypes)[id_col]
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")
