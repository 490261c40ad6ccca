"""Words as the contracts define them."""

import re

from daygrain.llm.common import plain_words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def test_plain_words():
    text = "Abc-É K 漢字_x\x00y\x7fz 12a É"
    assert [w.decode() for w in plain_words(text.encode())] == words(text)
