"""Cutting oversized texts into pieces at natural boundaries, each piece repeating the end of the one before.

Cuts are defined by content: a rolling hash over windows of words sets landmarks, and a piece ends at the natural boundary
nearest to the first landmark between its minimum and its maximum size. So an edit moves only the cuts near it. Natural
boundaries are, from strong to weak, blank lines, line ends and sentence ends; where a window has none, the landmark itself or
the maximum is the cut.

Defined cases
    Null texts give no piece; empty and blank ones neither. Words are runs of anything but Unicode white space. A text of at most
    `most` words is one piece. Every piece is a span of the text as written, so the pieces without their overlaps give it back
    in full, but for the white space between pieces. Repeated rows of a key give one set of pieces. Texts of any length are
    cut in time in proportion to their length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusmill.runtime import ship

MOST, OVERLAP, WINDOW, MASK = 380, 40, 6, 0x1F
_words = re.compile(r"\S+").finditer
_closing = re.compile(r"""[.!?。！？…]["'”’»)\]]*$""")


def boundary_strength(text: str, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each word, how natural a cut after it is: 3 a blank line follows, 2 a line end, 1 it closes a sentence, 0 none."""
    strength = np.zeros(len(ends), "int8")
    for i, (end, nxt) in enumerate(zip(ends.tolist(), [*starts[1:].tolist(), len(text)])):
        gap = text[end:nxt]
        if any(mark in gap for mark in ("\n", "\r", "\x85", "\u2028", "\u2029")):
            strength[i] = 3 if gap.replace("\r\n", "\n").replace("\r", "\n").count("\n") > 1 else 2
        elif _closing.search(text[max(0, end - 6) : end]):
            strength[i] = 1
    return strength


def landmarks(words: list[str]) -> np.ndarray:
    """Words at which the hash of the last WINDOW words has its low bits at zero: one in 32 words on average."""
    h = np.fromiter((zlib_hash(w) for w in words), "uint64", len(words))
    rolled = np.zeros(len(words), "uint64")
    for k in range(WINDOW):  # the window's polynomial hash, vectorized over all positions
        shifted = np.zeros_like(h)
        shifted[k:] = h[: len(h) - k]
        rolled = rolled * np.uint64(0x100000001B3) + shifted
    rolled ^= rolled >> np.uint64(29)
    return (rolled * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) & np.uint64(MASK) == 0


def zlib_hash(word: str) -> int:
    import zlib

    return zlib.crc32(word.encode("utf-8", "surrogatepass"))


def cut_points(words: list[str], strength: np.ndarray, most: int = MOST, overlap: int = OVERLAP) -> list[int]:
    """Ends of the pieces, as numbers of words; each piece with its overlap has at most `most` words."""
    n, start, cuts = len(words), 0, []
    marks = landmarks(words) if n > most else None
    while n - start > (room := most if not cuts else most - overlap):
        low, high = start + max(1, room // 2), start + room  # a cut c keeps words start..c-1
        window = strength[low - 1 : high]
        best = int(window.max())
        at = np.flatnonzero(marks[low - 1 : high])
        mark = low + int(at[0]) if len(at) else high
        natural = np.flatnonzero(window == best) + low if best else np.array([mark])
        cuts.append(int(natural[np.argmin(np.abs(natural - mark))]))
        start = cuts[-1]
    return [*cuts, n] if n else []


def pieces(text: str | None, most: int = MOST, overlap: int = OVERLAP) -> list[tuple[int, int, int, int]]:
    """Pieces of a text as (first character, character after the last, words, words repeated from the piece before)."""
    if not text:
        return []
    spans = [m.span() for m in _words(text)]
    if not spans:
        return []
    if len(spans) <= most:
        return [(spans[0][0], spans[-1][1], len(spans), 0)]
    starts, ends = np.array(spans).T
    cuts = cut_points([text[a:b] for a, b in spans], boundary_strength(text, starts, ends), most, overlap)
    out, start = [], 0
    for c in cuts:
        repeated = min(overlap, start)
        out.append((int(starts[start - repeated]), int(ends[c - 1]), c - start + repeated, repeated))
        start = c
    return out


def split_texts(df: DataFrame, keys: list[str], text_col: str, most: int = MOST, overlap: int = OVERLAP, oversized_only: bool = False) -> DataFrame:
    """Rows (keys, piece_no, n_pieces, piece, n_words, overlap_words). oversized_only: no rows for texts of a single piece."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, no, of, body, words, again = [], [], [], [], [], []
            for i, text in enumerate(batch.column(len(keys)).to_pylist()):
                found = pieces(text, most, overlap)
                if len(found) < 2 and oversized_only:
                    continue
                for k, (a, b, n, r) in enumerate(found):
                    row.append(i)
                    no.append(k)
                    of.append(len(found))
                    body.append(text[a:b])
                    words.append(n)
                    again.append(r)
            kept = [batch.column(i).take(pa.array(row, pa.int64())) for i in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(x, pa.int32()) for x in (no, of)), pa.array(body, pa.string()), *(pa.array(x, pa.int32()) for x in (words, again))], [*keys, "piece_no", "n_pieces", "piece", "n_words", "overlap_words"])

    types = dict(df.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "piece_no int, n_pieces int, piece string, n_words int, overlap_words int"])
    return df.where(F.col(text_col).isNotNull()).select(*keys, text_col).mapInArrow(run, schema)
