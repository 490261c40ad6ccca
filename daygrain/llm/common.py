"""Word splitting and Arrow plumbing shared by the operators that work in numpy.

Two splits are used.  ``PLAIN``: ASCII letters lower-cased, a word is a run of
letters, digits and non-ASCII characters.  ``SPACED``: a run of anything but
ASCII white space.  Both work on UTF-8 bytes because all separators are ASCII.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from daygrain.session import ship  # noqa: F401 - the operators take it from here

#: A-Z become a-z; control characters, spaces and ASCII punctuation become 0.
PLAIN = np.array([c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 0
                  for c in range(256)], np.uint8)
PLAIN_SPACES = bytes(c or 32 for c in PLAIN.tolist())
#: The word classes of ``PLAIN`` as Java patterns on the original text (A-Z included).
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAP_PATTERN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SPACED_PATTERN = r"[^\x20\x09-\x0D]+"

#: Bytes hashed at a time; longer texts are cut at a separator.
CHUNK = 1 << 21
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = np.cumprod(np.full(CHUNK + 1, _BASE, np.uint64)) * np.uint64(pow(_BASE, -1, 1 << 64))
_INVERSE = np.cumprod(np.full(CHUNK + 1, pow(_BASE, -1, 1 << 64), np.uint64)) * np.uint64(_BASE)


def packed(docs: DataFrame, **keys: Column) -> DataFrame:
    """Whole rows as one column ``_row`` beside some keys, so that no name of theirs clashes with a name used here."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                       *[column.alias(name) for name, column in keys.items()])


def plain_words(text: bytes) -> list[bytes]:
    """The words of one text as bytes."""
    return text.translate(PLAIN_SPACES).split()


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the entropy of 64-bit values over all their bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


@dataclass
class Words:
    """The words of consecutive texts: 64-bit hashes, first-letters hashes, text index and place in the text."""

    hashes: np.ndarray
    stems: np.ndarray
    text: np.ndarray
    place: np.ndarray


def _pieces(texts: list[bytes]) -> Iterator[list[tuple[int, bytes]]]:
    """(text index, part of the text) in groups of about ``CHUNK`` bytes; a longer text is cut between words."""
    group: list[tuple[int, bytes]] = []
    size = 0
    for i, text in enumerate(texts):
        if size + len(text) + 1 > CHUNK and group:
            yield group
            group, size = [], 0
        while len(text) >= CHUNK:
            part = text[:CHUNK - 1]
            cut = len(part.translate(PLAIN_SPACES).rpartition(b" ")[0]) or len(part)
            yield [(i, text[:cut])]
            text = text[cut:]
        group.append((i, text))
        size += len(text) + 1
    if group:
        yield group


def hashed_words(texts: list[bytes], stem: int = 5) -> Iterator[Words]:
    """Hash every word of every text, a few megabytes at a time and without a loop over words.

    A word's hash is a polynomial in its bytes, taken as a difference of prefix
    sums.  Places go on where a long text goes over several pieces.  Without ``stem`` letters there are no stems.
    """
    last, seen = -1, 0
    for group in _pieces(texts):
        data = PLAIN[np.frombuffer(b"\0".join(part for _, part in group), np.uint8)]
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = data != 0
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(data * _POWERS[:len(data)], out=sums[1:])
        back = _INVERSE[starts]
        hashes = mixed((sums[ends] - sums[starts]) * back)
        stems = mixed((sums[np.minimum(starts + stem, ends)] - sums[starts]) * back + np.uint64(1)) if stem else hashes[:0]
        members = np.array([i for i, _ in group])
        bounds = np.cumsum([0] + [len(part) + 1 for _, part in group])
        counts = np.diff(np.searchsorted(starts, bounds))
        place = np.arange(len(starts)) - np.repeat(np.cumsum(counts) - counts, counts)
        before = seen if members[0] == last else 0
        place[:counts[0]] += before
        seen = int(counts[-1]) + (before if len(group) == 1 else 0)
        last = members[-1]
        yield Words(hashes, stems, np.repeat(members, counts), place)
