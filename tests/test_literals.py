"""Literals against Python's own reader."""

import ast
import random
import warnings

from pyspark.sql import functions as F

from daygrain.functions import encoding as E, literals as L

STRINGS = ["minor", "", " a b ", "it's", 'say "hi"', "back\\slash", "new\nline", "tab\t", "ünï 漢字", "}{][", "a: b, c", "None", "\x07\x0b", "\x00"]


def value(draw, depth):
    kind = draw.randrange(9 if depth < 3 else 6)
    if kind < 4:
        return draw.choice(STRINGS)
    if kind < 6:
        return draw.choice([None, True, False, 0, 7, -12, 1.5, -0.25, 10**15])
    size = draw.randrange(4)
    if kind == 6:
        return [value(draw, depth + 1) for _ in range(size)]
    if kind == 7:
        return tuple(value(draw, depth + 1) for _ in range(size))
    return {draw.choice([draw.choice(STRINGS), draw.randrange(5), (1, "a"), None]): value(draw, depth + 1) for _ in range(size)}


def spoiled(draw, text):
    at = draw.randrange(len(text) + 1)
    return draw.choice([text[:at] + text[at + 1:], text[:at] + draw.choice("[](){}:,'\"\\ 1aN") + text[at:], text[:at]])


def loose(draw, text):
    """The same literal in other spellings: trailing commas and white space."""
    for close in "])}":
        if draw.random() < 0.5 and text.endswith(close) and text[:-1].strip("[({") and not text[:-1].endswith(","):
            text = text[:-1] + draw.choice([",", " , ", "\n,\t"]) + close
    return draw.choice(["", "  ", "\n\t"]) + text + draw.choice(["", " ", "\r\n"])


EDGES = ["", " ", "[]", "()", "{}", "{1}", "{1, 2,}", "(1,)", "[(1,), (1, 2,)]", "['a' 'b', \"c\" 'd']", "{'a': 1, 'a': 2, 'b': 3}", "[,]", "{,}", "{'a'}",
         "{'a':}", "{'a': 1 'b': 2}", "['a']['b']", "[1 2]", "['a'", "'a']", "[None, True, False]", "[none]", "{'a': {'b': ['c', ('d',)]}, }", "{[1]: 2}",
         "{{}: 1}", "{(1, 2): 3}", "[{1: 2}, {3}]", "u'x'", "[u'x', U\"y\"]", "['\\x41\\u0042\\103\\n\\q\\'', \"\\\"\"]", "[1.0, -1.5, +2, .5, 5., 0]", "[007]",
         "[1a]", "7", "'x'", "None", "[\n 'a',\n 'b'\n]", "['a\nb']", "{'k': None}", "{None: 'v'}", "[[], [[]], ()]", "{'left_foot': 'minor', 'right_knee': 'major', }",
         "{\"a\": 'x'}", "[1, 2", "(1, 2]", "{1: 2)", "{1: 2, 3}", "{1, 2: 3}", "['\\U0001F600']"]


def expected(text):
    """(map, list) of one text by Python's reader."""
    try:
        found = ast.literal_eval(text.strip())
    except (SyntaxError, ValueError, TypeError, MemoryError):
        found = None
    as_map = {str(k): str(v) for k, v in found.items()} if isinstance(found, dict) else {}
    return as_map, [str(x) for x in found] if isinstance(found, (list, tuple)) else []


def odd(text):
    """Spellings that the module says it does not read, and keys of unlike type that are one text."""
    try:
        warnings.simplefilter("ignore", SyntaxWarning)
        tree = ast.parse(text.strip(), mode="eval")
        found = ast.literal_eval(text.strip())
    except (SyntaxError, ValueError, TypeError):
        return False
    keys = [str(k) for k in found] if isinstance(found, dict) else []
    nodes = list(ast.walk(tree))
    rare = any(isinstance(n, ast.Constant) and isinstance(n.value, (bytes, complex, type(...))) for n in nodes)
    controls = any(isinstance(n, ast.Constant) and isinstance(n.value, str) and not n.value.replace("\n", "").replace("\t", "").isprintable() for n in nodes)
    nested = any(isinstance(n, (ast.List, ast.Tuple, ast.Dict, ast.Set)) for n in nodes[2:])
    sums = any(isinstance(n, ast.BinOp) for n in nodes)
    grouped = compact(text) != compact(ast.unparse(tree))
    bare = isinstance(tree.body, ast.Tuple) and not text.strip().startswith("(")
    return len(keys) != len(set(keys)) or bare or rare or sums or (controls and nested) or grouped and "(" in text


def compact(text):
    return [t for t in text.replace(" ", "").replace(",", "") if t in "()"]


def test_generated_literals(spark):
    draw = random.Random(12)
    texts = list(EDGES)
    for _ in range(1500):
        text = loose(draw, repr(value(draw, 0)))
        texts += [text, spoiled(draw, text)]
    texts = [t for t in dict.fromkeys(texts) if not odd(t)]
    assert len(texts) > 1500
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select(
        "i", E.parse_map("t").alias("m"), E.soreness("t")["areas"].alias("l"))
    assert "Python" not in rows._jdf.queryExecution().executedPlan().toString()
    for r in rows.collect():
        want = expected(texts[r["i"]])
        assert (r["m"], r["l"]) == want, texts[r["i"]]


def test_kinds(spark):
    texts = ["['a']", "('a',)", "{'a': 1}", "{}", "{1}", "'a'", "7", "['a'", "('a')", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", L.literal("t")["kind"].alias("k")).orderBy("i")
    assert [r["k"] for r in rows.collect()] == ["list", "list", "dict", "dict", "other", "other", "other", None, None, None]


def test_long_texts(spark):
    long = "['" + "x" * 200_000 + "', '" + "\\'" * 50_000 + "']"
    many = repr([f"name {i}" for i in range(2000)])
    out = spark.createDataFrame([(long,), (many,)], "t string").select(F.size(L.list_items("t")).alias("n"), F.length(L.list_items("t")[0]).alias("s")).collect()
    assert [tuple(r) for r in out] == [(2, 200_000), (2000, 6)]
