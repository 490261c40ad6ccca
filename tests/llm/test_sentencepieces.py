import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st

from cases import ODD
from daygrain.llm import sentencepieces as sp
from daygrain.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
VOCABULARY = sp.read_vocabulary(PATH)
ENCODER, DECODER = sp.Encoder(VOCABULARY), sp.Decoder(VOCABULARY)


def agrees(text):
    ids = LIBRARY.encode(text)
    assert ENCODER.encode(text) == ids, text
    assert DECODER.decode(ids) == LIBRARY.decode(ids), text


@given(st.text(max_size=60))
@settings(max_examples=500, deadline=None)
def test_any_text(text):
    agrees(text)


def test_texts_of_pieces():
    draw = random.Random(1)
    for _ in range(4000):
        parts = (draw.choice(VOCABULARY.pieces) for _ in range(draw.randrange(9)))
        agrees("".join(p.replace(sp.SPACE, draw.choice(["", " ", sp.SPACE])) for p in parts))


@pytest.mark.parametrize("text", ["", " ", "   ", "\n\n", "a" * 5000, " " * 700, "x  ", "\x00", "<s>", "<0x41>", "﻿", "▁▁a", "日本語" * 900,
                                  "\U0001F600" * 99, "ab́" * 50, "٣" * 30])
def test_hard_texts(text):
    agrees(text)


def test_pairs_stand_together_exactly_if_the_library_leaves_them():
    draw = random.Random(2)
    normal = [i for i, kind in enumerate(VOCABULARY.kinds) if kind == sp.NORMAL and sp.SPACE not in VOCABULARY.pieces[i]]
    space = LIBRARY.piece_to_id(sp.SPACE)
    compared = 0
    for _ in range(6000):
        a, b = draw.choice(normal), draw.choice(normal)
        ids = LIBRARY.encode(VOCABULARY.pieces[a] + VOCABULARY.pieces[b])
        if ids[0] == space:  # the space in front stands on its own, so the rest is the encoding of the pair
            compared += 1
            assert ENCODER.compatible(a, b) == (ids[1:] == [a, b])
    assert compared > 500


def test_one_last_token_per_prefix():
    """The table of a text ends every prefix with what the library ends it with."""
    word = sp.SPACE + "internationalisation"
    table = ENCODER.last_tokens(word)
    assert table[2:] == [LIBRARY.encode(word[1:n])[-1] for n in range(2, len(word) + 1)]


def test_small_memory_gives_the_same(monkeypatch):
    monkeypatch.setattr(sp, "REMEMBERED", 3)
    monkeypatch.setattr(sp, "PAIRS", 5)
    encoder = sp.Encoder(VOCABULARY)
    texts = ["one two three four five six seven", "two three one nine", "eight two one"] * 3
    assert [encoder.encode(t) for t in texts] == LIBRARY.encode(texts)


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2
    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(open(PATH, "rb").read())
    model.trainer_spec.model_type = 1
    model.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "other.model").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError, match="byte-pair merges, kept white space"):
        sp.read_vocabulary(str(tmp_path / "other.model"))


def test_odd_cases(odd, empty):
    encoded = sp.encode(odd, VOCABULARY)
    rows = sp.decode(encoded, VOCABULARY).collect()
    assert sorted(map(str, ((r["id"], r["ids"], r["text"]) for r in rows))) == sorted(
        str((i, LIBRARY.encode(t or ""), t or "")) for i, t in ODD)
    assert sp.decode(sp.encode(empty, VOCABULARY), VOCABULARY).count() == 0
    both = sp.encode(odd, VOCABULARY, round_trip=True)
    assert sorted(map(str, both.collect())) == sorted(map(str, rows)) and sp.encode(empty, VOCABULARY, round_trip=True).count() == 0


def test_decode_keeps_other_columns(spark):
    rows = spark.createDataFrame([(None, "x"), ([1, 99_999, None], "y"), ([28705, 13], "z")], "ids array<int>, `a.b` string")
    out = sp.decode(rows, VOCABULARY)
    assert out.columns == ["ids", "a.b", "text"] and [(r[1], r[2]) for r in out.collect()] == [("x", ""), ("y", ""), ("z", "\n")]


def test_query_matches_the_library(spark):
    def sha(s):
        return hashlib.sha256(s.encode()).hexdigest()

    want = []
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = LIBRARY.encode(r["text"] or "")
        want.append((r["doc_id"], len(ids), sha(",".join(map(str, ids))), sha(LIBRARY.decode(ids))))
    assert sorted(map(tuple, QUERIES["op11_sentencepiece"](spark, SF).collect())) == sorted(want)


def test_words_are_remembered_where_they_are_looked_up():
    """A word is encoded at its first look-up; long words are not kept, used ones survive a change of the table."""
    encoder = sp.Encoder(VOCABULARY)
    short, long = sp.SPACE + "word", sp.SPACE + "word" * sp.WORD_LENGTH
    assert encoder.known[short] == encoder.encode_word(short) and encoder.known[long] == encoder.encode_word(long)
    assert set(encoder.known) == {short}
    assert sp.Remembered(encoder, {short: (7,)})[short] == (7,)
