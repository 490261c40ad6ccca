"""SentencePiece byte-pair encoding through a table of last tokens, and decoding.

The result equals that of the sentencepiece library with the same model.
Instead of replaying merges over a text:

1. The text is normalised as the model asks (a space in front, spaces become
   ``U+2581``).
2. For every prefix the table keeps the one token its encoding ends with.  An
   Aho-Corasick automaton lists the pieces that end at a place; the right one
   is the piece that may stand after the last token of the prefix before it.
3. Two tokens may stand beside each other if the merges of both, played in the
   order of their scores, are never overtaken by a merge across their border.
   Merges across a border depend on the two tokens alone, so a sequence is the
   encoding of its text exactly if every neighbouring pair may stand together.
4. Ids are recovered backwards from the end of the table.

The table is linear in the length of a text.  Where no piece goes from a
letter over to a space, texts fall into words that are encoded on their own,
and short words are remembered (``REMEMBERED`` of them at a time).

The vocabulary is read on the driver and broadcast; its size is that of the
model and does not depend on the data.  Work is one pass of Arrow batches
without a shuffle.

Defined cases: null and empty texts have no ids and decode to an empty text.
Characters outside the vocabulary become the ids of their UTF-8 bytes.  Bytes
that are no UTF-8 count as U+FFFD.  Very long texts, repeated rows, null ids
and extra columns need no care: rows are independent and only the id and the
text are read.  Empty tables give empty results.  Null lists and unknown ids
decode to an empty text and to nothing.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType

from daygrain.llm.common import ship, utf8

SPACE = "▁"
#: Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)
#: Words up to this length are remembered, so many words, and pairs and steps of the automaton, at a time.
WORD_LENGTH, REMEMBERED, PAIRS = 48, 50_000, 300_000
#: Rows that are worked on and handed back at a time.
ROWS = 200


@dataclass(frozen=True)
class Vocabulary:
    """Pieces, scores and kinds by id."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: tuple[int, ...]


def read_vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a model file; raises if the model is not of the kind this module encodes."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    rules, trained = model.normalizer_spec, model.trainer_spec
    kinds = tuple(p.type for p in model.pieces)
    wanted = {
        "byte-pair merges": trained.model_type == 2, "byte fallback": trained.byte_fallback and kinds.count(BYTE) == 256,
        "no character mapping": not rules.precompiled_charsmap, "a space in front": rules.add_dummy_prefix,
        "kept white space": not rules.remove_extra_whitespaces, "spaces as U+2581": rules.escape_whitespaces,
        "spaces before words": not trained.treat_whitespace_as_suffix,
        "no user-defined or unused pieces": USER_DEFINED not in kinds and UNUSED not in kinds,
        "all its characters as pieces": set("".join(p.piece for p in model.pieces if p.type == NORMAL))
        <= {p.piece for p in model.pieces if p.type == NORMAL}}
    if missing := [name for name, holds in wanted.items() if not holds]:
        raise ValueError(f"{path} needs: {', '.join(missing)}")
    return Vocabulary(tuple(p.piece for p in model.pieces), tuple(p.score for p in model.pieces), kinds)


#: Stands before the first token of a text.
START = -1


class State(dict):
    """A state of the automaton: the longest end of the text so far that starts a piece.

    Its entries are the states behind the next character, found when first
    asked for; ``ends`` are the (id, length) of the pieces that end here,
    longest first.
    """

    __slots__ = ("encoder", "text", "ends")

    def __init__(self, encoder: Encoder, text: str):
        self.encoder, self.text = encoder, text
        ids = encoder.ids
        self.ends = tuple((ids[text[i:]], len(text) - i) for i in range(len(text)) if text[i:] in ids)

    def __missing__(self, char: str) -> State:
        text = self.text + char
        while text not in self.encoder.prefixes:
            text = text[1:]
        state = self[char] = self.encoder.state(text)
        self.encoder.found += 1
        return state


class Followers(dict):
    """Whether a token may stand behind a given one, found when first asked for."""

    __slots__ = ("encoder", "left")

    def __init__(self, encoder: Encoder, left: int):
        self.encoder, self.left = encoder, left

    def __missing__(self, right: int) -> bool:
        self.encoder.found += 1
        fits = self[right] = self.encoder.compatible(self.left, right)
        return fits


class Remembered(dict):
    """The ids of words, found when first asked for; long words are not kept."""

    __slots__ = ("encoder", "older")

    def __init__(self, encoder: Encoder, older: dict[str, tuple[int, ...]]):
        self.encoder, self.older = encoder, older

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = self.older.get(word) or self.encoder.encode_word(word)
        if len(word) <= WORD_LENGTH:
            self[word] = found
        return found


class Encoder:
    """Encodes texts of one vocabulary; remembers what it found out about characters, pairs and words."""

    def __init__(self, vocabulary: Vocabulary):
        self.pieces = vocabulary.pieces
        known = [(p, i) for i, (p, kind) in enumerate(zip(vocabulary.pieces, vocabulary.kinds, strict=True)) if kind == NORMAL]
        self.ids = dict(known)
        self.prefixes = {p[:n] for p in self.ids for n in range(len(p) + 1)}
        self.scores = {p: vocabulary.scores[i] for p, i in known}
        self.bytes = {int(p[1:-1], 16): i for i, p in enumerate(vocabulary.pieces) if vocabulary.kinds[i] == BYTE}
        self.single = {p for p in self.ids if len(p) == 1}
        parted = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.words = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+" if parted else r"(?s).+").findall
        #: Characters outside the vocabulary merge with nothing, so texts fall apart there too.
        letters = "".join(map(re.escape, sorted(self.single)))
        self.parts = re.compile(f"[{letters}]+|[^{letters}]").findall
        self.histories: dict[int, tuple | None] = {}
        self.sizes = list(map(len, self.pieces))
        self.known = Remembered(self, {})
        self.forget()

    def forget(self) -> None:
        """Start with an empty automaton and no pairs."""
        self.states: dict[str, State] = {}
        self.pairs: dict[int, Followers] = {START: Followers(self, START)} | {i: Followers(self, i) for i in self.ids.values()}
        self.found = 0

    def state(self, text: str) -> State:
        """The state of a text that starts a piece."""
        if text not in self.states:
            self.states[text] = State(self, text)
        return self.states[text]

    def history(self, token: int) -> tuple | None:
        """How the merges of a token run: their scores, and the first and last symbol before, between and after them.

        None for a piece that its own merges do not lead to, which no encoding holds.
        """
        if token not in self.histories:
            symbols, scores = list(self.pieces[token]), []
            firsts, lasts = [symbols[0]], [symbols[-1]]
            while len(symbols) > 1:
                best, at = max((self.scores.get(a + b, float("-inf")), -i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])))
                if best == float("-inf"):
                    break
                symbols[-at:2 - at] = ["".join(symbols[-at:2 - at])]
                scores.append(best)
                firsts.append(symbols[0])
                lasts.append(symbols[-1])
            self.histories[token] = (scores, firsts, lasts) if len(symbols) == 1 else None
        return self.histories[token]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens are the encoding of their joint text; at the start, whether the token is one of its own."""
        if left == START:
            return self.history(right) is not None
        a, b = self.history(left), self.history(right)
        if a is None or b is None:
            return False
        i = j = 0
        while True:
            across = self.scores.get(a[2][i] + b[1][j])
            more_a, more_b = i < len(a[0]), j < len(b[0])
            # The best score goes first; of equal ones that further left, which is the left token's, then the one across.
            if across is not None and not (more_a and a[0][i] >= across) and not (more_b and b[0][j] > across):
                return False
            if not more_a and not more_b:
                return True
            if more_a and not (more_b and b[0][j] > a[0][i]):
                i += 1
            else:
                j += 1

    def last_tokens(self, text: str) -> list[int]:
        """The last token of every prefix, by the length of the prefix; all characters are pieces."""
        table, pairs, state = [START], self.pairs, self.state("")
        for char in text:
            state = state[char]
            for token, size in state.ends:
                # The table has the prefixes before this character, so a size counts from its end.
                if pairs[table[-size]][token]:
                    table.append(token)
                    break
        return table

    def encode_word(self, word: str) -> tuple[int, ...]:
        """The ids of one part of a text, from the end of its table to the front."""
        ids: list[int] = []
        sizes = self.sizes
        for part in reversed(self.parts(word)):
            if len(part) == 1 and part not in self.single:
                ids.extend([self.bytes[b] for b in reversed(part.encode())])
                continue
            table, at = self.last_tokens(part), len(part)
            while at:
                token = table[at]
                ids.append(token)
                at -= sizes[token]
        return tuple(reversed(ids))

    def encode(self, text: str) -> list[int]:
        """The ids of one text."""
        if not text:
            return []
        if self.found > PAIRS:
            self.forget()
        if len(self.known) > REMEMBERED:  # what was used since the last time stays
            self.known = Remembered(self, dict(self.known))
        return list(chain.from_iterable(map(self.known.__getitem__, self.words(SPACE + text.replace(" ", SPACE)))))


class Decoder:
    """Turns ids back into texts."""

    def __init__(self, vocabulary: Vocabulary):
        kinds, pieces = vocabulary.kinds, vocabulary.pieces
        self.table = {i: bytes([int(p[1:-1], 16)]) if kinds[i] == BYTE else b"" if kinds[i] == CONTROL
                      else " ⁇ ".encode() if kinds[i] == UNKNOWN else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)}
        self.spaced = {i for i, p in enumerate(pieces) if kinds[i] == NORMAL and p.startswith(SPACE)}

    def decode(self, ids: list[int]) -> str:
        """The text of one list of ids, without the space that encoding put in front."""
        text = b"".join(map(self.table.get, ids, repeat(b"")))
        return text[bool(ids) and ids[0] in self.spaced:].decode("utf-8", "replace")


_BUILT: dict[tuple[type, int], object] = {}


def _built(kind: type, vocabulary: Vocabulary):
    """One object per vocabulary and worker process."""
    key = kind, hash(vocabulary)
    if key not in _BUILT:
        _BUILT[key] = kind(vocabulary)
    return _BUILT[key]


def encode(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text", round_trip: bool = False) -> DataFrame:
    """(id, ids): the ids of every text, one row per row of ``docs``.

    With ``round_trip`` the column ``text`` has what the ids decode to, in the
    same pass.
    """
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = rows.select("id").schema.add("ids", ArrayType(IntegerType()))
    schema = schema.add("text", "string") if round_trip else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _built(Encoder, sent.value), _built(Decoder, sent.value)
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            flat, ends, texts = array("i"), [0], []
            for text in utf8(batch.column(1)):
                ids = encoder.encode(text.decode("utf-8", "replace"))
                flat.extend(ids)
                ends.append(len(flat))
                if round_trip:
                    texts.append(decoder.decode(ids))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, np.int32)))
            columns = [batch.column(0), lists, *([pa.array(texts, pa.string())] if round_trip else [])]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """``encoded`` with the text of every list of ids."""
    ship(encoded.sparkSession)
    sent = encoded.sparkSession.sparkContext.broadcast(vocabulary)
    kept = [c for c in encoded.columns if c != out_col]
    # Numbered names inside, since the names of a caller may clash or hold dots.
    rows = encoded.select(F.col(f"`{ids_col}`").alias("ids"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _built(Decoder, sent.value)
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            sizes = pc.fill_null(pc.list_value_length(batch.column(0)), 0).to_numpy()
            ends = np.cumsum(sizes).tolist()
            flat = pc.fill_null(batch.column(0).flatten(), START).to_numpy().tolist()
            texts = pa.array([decoder.decode(flat[end - n:end]) for n, end in zip(sizes.tolist(), ends, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], texts], names=[*batch.schema.names[1:], "text"])

    return rows.mapInArrow(run, rows.drop("ids").schema.add("text", "string")).toDF(*kept, out_col)
