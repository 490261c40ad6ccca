"""Rows with the cases every operator must take."""

import random

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, id long, name string, fp long, place double, _k_id long"


def rows(texts):
    """(doc_id, text) pairs with the other columns, some of them null, some with names the operators use inside."""
    return [(i, t, None if i is None or i % 3 == 0 else "en", None if i is None or i % 4 == 0 else f"s{i % 2}", 1, 7, "x", 3, 0.5, 9)
            for i, t in texts]


RANDOM = random.Random(5)
LONG = " ".join(RANDOM.choice("abcdefgh") * k for k in range(1, 40) for _ in range(60))
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "Two words"), (6, "two  words"), (6, "two  words"), (7, LONG),
       (8, LONG + " end"), (9, LONG), (None, "no id"), (None, None), (10, "ünï¢ödé 漢字 \U0001F600 x"), (11, "a b c d e f g h i j k l"),
       (12, "A  b c d e f g h i j k l"), (13, "%%% *** !!!")]
