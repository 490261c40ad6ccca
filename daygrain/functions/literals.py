"""Dict and list literals read by a pushdown automaton in column expressions.

Texts such as ``{'left_foot': 'minor', }`` or ``("hip", None)`` are cut into
tokens by one pattern; a fold over the tokens steps through a table of
(state, innermost bracket, kind of token) with the open brackets as its stack.
What does not step to the end is no literal.

Read: single and double quotes with escapes, strings side by side (joined),
numbers, ``None``, ``True``, ``False``, lists, tuples, dicts, sets, nesting and
trailing commas.  Items come back as text: strings as they are, whole numbers
and names as written, other numbers as doubles, nested containers as they would
be written.  Not read: other prefixes than ``u``, triple quotes, complex and
hexadecimal numbers, digits with underscores, tuples without brackets, and brackets around a single value
that make no tuple.
Lists and dicts as keys or set members are no literals.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

ESCAPED = r"\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U(?:000[0-9a-fA-F]|0010)[0-9a-fA-F]{4}|[^xuUN])"
STRING = rf"""[uU]?(?:'[^'\\\n]*+(?:{ESCAPED}[^'\\\n]*+)*+'|"[^"\\\n]*+(?:{ESCAPED}[^"\\\n]*+)*+")"""
EXPONENT = r"[eE][+-]?\d++"
NUMBER = rf"(?:[+-]\s*+)?(?:\d++\.\d*+(?:{EXPONENT})?|\d++{EXPONENT}|\.\d++(?:{EXPONENT})?|0++|[1-9]\d*+)(?![\w.])"
TOKEN = rf"(?:{STRING}\s*)++|{NUMBER}|(?:None|True|False)\b|[\[\](){{}}:,]"
ESCAPE = r"\\U[0-9a-fA-F]{8}|\\u[0-9a-fA-F]{4}|\\x[0-9a-fA-F]{2}|\\[0-7]{1,3}|\\[\s\S]|[^\\]++"
BLANKS = " \t\r\n\f\v"

#: Kinds of tokens; x is a string, a number or a name.
KINDS = "x[({])}:,"
#: Innermost brackets: ( has no comma yet, o one, t more; { is a dict or a set, d a dict before a colon, v behind it, s a set.
TOPS = "-[(ot{dvs"
#: What may come next: S the literal; F an item or the end; V an item or the end, behind a comma; B a key, a member or the end;
#: K a key or the end, behind a comma; W the value of a key; C a colon, a comma or the end; D a colon; A a comma or the end.
STATES = "SFVBKWCDA"
#: The state behind a container, by the bracket that it stands in.
BEHIND = ("[(otsv{d", "AAAAAACD")


def _transitions() -> dict[str, str]:
    """(state, top, kind) -> (next state, + push or - pop or = swap, new top, what is done with the text)."""
    table = {}
    scalar = {"S": "E", "F": "A", "V": "A", "W": "A", "B": "C", "K": "D"}
    for top in TOPS:
        for state, then in scalar.items():
            table[state + top + "x"] = then + "=" + top + "a"
            for kind in "[({":
                if kind == "(" or state not in "BK" and not (top == "s" and state == "V"):
                    table[state + top + kind] = ("B" if kind == "{" else "F") + "+" + kind + "o"
    for state, top in (("C", "{"), ("D", "d")):
        table[state + top + ":"] = "W=vk"
    for top, swapped, then in (("[", "[", "V"), ("(", "o", "V"), ("o", "t", "V"), ("t", "t", "V"), ("s", "s", "V"), ("v", "d", "K")):
        table["A" + top + ","] = then + "=" + swapped + "c"
    table["C{,"] = "V=sc"
    for tops, kind in (("[", "]"), ("(ot", ")"), ("{dvs", "}")):
        for top in tops:
            for state in "FVBKCA":
                if top + state != "(A":
                    text = ("w" if top == "o" else "y") if state in "VK" else "z"
                    table[state + top + kind] = "?-" + top + text
    return table


_TABLE = _transitions()


def _one_of(column: Column, cases: dict[str, Column], default: Column) -> Column:
    return reduce(lambda rest, case: F.when(column == case[0], case[1]).otherwise(rest), reversed(cases.items()), default)


def _decoded(literal: Column) -> Column:
    """The text of one string literal."""
    body = F.regexp_replace(literal, r"^[uU]", "")
    body = F.substring(body, F.lit(2), F.length(body) - 2)

    def unescaped(piece: Column) -> Column:
        mark = F.substring(piece, 2, 1)
        rest = F.substring(piece, F.lit(3), F.length(piece))
        wide = _one_of(mark, {"x": F.decode(F.unhex(F.concat(F.lit("00"), rest)), "UTF-16BE"), "u": F.decode(F.unhex(rest), "UTF-16BE"),
                              "U": F.decode(F.unhex(rest), "UTF-32")}, piece)
        short = _one_of(mark, {"n": F.lit("\n"), "t": F.lit("\t"), "r": F.lit("\r"), "b": F.lit("\b"), "f": F.lit("\f"), "v": F.lit("\v"),
                               "a": F.lit("\a"), "\n": F.lit(""), "'": mark, '"': mark, "\\": mark}, piece)
        octal = F.decode(F.unhex(F.lpad(F.conv(F.substring(piece, F.lit(2), F.length(piece)), 8, 16), 4, "0")), "UTF-16BE")
        return (F.when(~piece.startswith("\\"), piece).when(piece.rlike(r"^\\[0-7]"), octal)
                .when(F.length(piece) > 2, wide).otherwise(short))

    pieces = F.regexp_extract_all(body, F.lit(ESCAPE), F.lit(0))
    return F.when(~body.contains("\\"), body).otherwise(F.array_join(F.transform(pieces, unescaped), ""))


def _written(text: Column) -> Column:
    """A string as it stands inside a nested container."""
    escaped = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for raw, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(shown))
    double = text.contains("'") & ~text.contains('"')
    single = F.replace(escaped, F.lit("'"), F.lit("\\'"))
    return F.when(double, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(F.concat(F.lit("'"), single, F.lit("'")))


def _read(token: Column) -> Column:
    """(kind, value, written) of a token."""
    is_string = token.rlike(r"""^[uU]?['"]""")
    value = F.array_join(F.transform(F.regexp_extract_all(token, F.lit(STRING), F.lit(0)), _decoded), "")
    is_number = token.rlike(r"^[+\-.\d]")
    digits = F.regexp_replace(token, r"^\+|\s+", "")
    whole = F.when(digits.rlike(r"^-?0+$"), F.lit("0")).otherwise(digits)
    number = F.when(digits.rlike(r"^-?\d+$"), whole).otherwise(digits.try_cast("double").cast("string"))
    plain = F.when(is_number, number).otherwise(token)
    kind = F.when(is_string | is_number | token.rlike(r"^\w"), F.lit("x")).otherwise(token)
    return F.struct(kind.alias("kind"), F.when(is_string, value).otherwise(plain).alias("value"),
                    F.when(is_string, _written(value)).otherwise(plain).alias("written"))


def literal(c: Column | str) -> Column:
    """(kind, keys, values) of a literal; kind is ``list`` for lists and tuples, ``dict``, ``other``, or NULL for what is none."""
    text = F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(BLANKS))
    tokens = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: _read(F.btrim(t, F.lit(BLANKS))))
    nothing_else = F.regexp_replace(text, rf"{TOKEN}|\s++", "") == ""
    keys = [s + t + k for s in STATES for t in TOPS for k in KINDS]
    table = F.array(*[F.lit(_TABLE.get(key, "X=-n")) for key in keys])

    def step(acc: Column, token: Column) -> Column:
        depth = F.length(acc["stack"])
        top = F.when(depth == 0, F.lit("-")).otherwise(F.right(acc["stack"], F.lit(1)))
        place = ((F.instr(F.lit(STATES), acc["state"]) - 1) * len(TOPS) + F.instr(F.lit(TOPS), top) - 1) * len(KINDS) + F.instr(
            F.lit(KINDS), token["kind"]) - 1
        entry = F.when(acc["state"].isin("X", "E"), F.lit("X=-n")).otherwise(F.get(table, place))
        # The fold has no names for intermediate results, so they travel in a struct of one list.
        return F.transform(F.array(F.struct(depth.alias("depth"), top.alias("top"), entry.alias("entry"))), lambda now: _applied(acc, token, now))[0]

    start = F.struct(F.lit("S").alias("state"), F.lit("").alias("stack"), F.lit("").alias("text"), F.lit("").alias("key"),
                     F.array().cast("array<string>").alias("keys"), F.array().cast("array<string>").alias("values"), F.lit("other").alias("kind"))
    end = F.aggregate(tokens, start, step)
    done = F.transform(F.array(F.when(nothing_else, end)), lambda e: F.struct(
        F.when(e["state"] == "E", e["kind"]).alias("kind"), e["keys"].alias("keys"), e["values"].alias("values")))
    return done[0]


def _applied(acc: Column, token: Column, now: Column) -> Column:
    """The state of the fold behind one token."""
    depth, entry = now["depth"], now["entry"]
    move, swapped, act = F.substring(entry, 2, 1), F.substring(entry, 3, 1), F.substring(entry, 4, 1)
    below = F.substring(acc["stack"], F.lit(1), depth - 1)
    stack = _one_of(move, {"+": F.concat(acc["stack"], swapped), "-": below}, F.when(depth == 0, F.lit("")).otherwise(F.concat(below, swapped)))
    behind = F.when(depth == 1, F.lit("E")).otherwise(F.translate(F.right(below, F.lit(1)), *BEHIND))
    state = F.when(move == "-", behind).otherwise(F.substring(entry, 1, 1))
    text, outer = acc["text"], depth <= 1
    unpadded = F.substring(text, F.lit(1), F.length(text) - 2)
    inner = _one_of(act, {"a": F.concat(text, token["written"]), "o": F.concat(text, token["value"]), "c": F.concat(text, F.lit(", ")),
                          "k": F.concat(text, F.lit(": ")), "z": F.concat(text, token["value"]), "y": F.concat(unpadded, token["value"]),
                          "w": F.concat(unpadded, F.lit(",)"))}, text)
    first = _one_of(act, {"a": F.concat(text, token["value"]), "o": F.when(depth == 0, text).otherwise(F.concat(text, token["value"]))}, F.lit(""))
    ends_item = (depth == 1) & ((act == "c") | ((move == "-") & acc["state"].isin("A", "C")))
    is_dict = now["top"].isin("v", "d") | ((now["top"] == "{") & (acc["state"] == "B"))
    kind = F.when(is_dict, F.lit("dict")).when(now["top"].isin("[", "(", "o", "t"), F.lit("list")).otherwise(F.lit("other"))
    return F.struct(
        state.alias("state"), stack.alias("stack"), F.when(outer, first).otherwise(inner).alias("text"),
        F.when((depth == 1) & (act == "k"), text).otherwise(acc["key"]).alias("key"),
        F.when(ends_item, F.concat(acc["keys"], F.array(acc["key"]))).otherwise(acc["keys"]).alias("keys"),
        F.when(ends_item, F.concat(acc["values"], F.array(text))).otherwise(acc["values"]).alias("values"),
        F.when((depth == 1) & (move == "-"), kind).otherwise(acc["kind"]).alias("kind"))


def dict_items(c: Column | str) -> Column:
    """A dict literal as ``MAP<STRING,STRING>``, the last of equal keys; NULL for anything else."""
    pairs = F.transform(F.array(literal(c)), lambda e: F.struct(e["kind"].alias("kind"), F.arrays_zip(e["keys"].alias("k"), e["values"].alias("v")).alias("items")))
    return F.transform(pairs, lambda e: F.when(e["kind"] == "dict", F.map_from_entries(F.transform(
        F.array_distinct(F.transform(e["items"], lambda i: i["k"])),
        lambda key: F.struct(key.alias("key"), F.element_at(F.filter(e["items"], lambda i: i["k"] == key), -1)["v"].alias("value"))))))[0]


def list_items(c: Column | str) -> Column:
    """The items of a list or tuple literal as text; NULL for anything else."""
    return F.transform(F.array(literal(c)), lambda e: F.when(e["kind"] == "list", e["values"]))[0]
