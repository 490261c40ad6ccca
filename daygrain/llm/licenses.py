"""License scan: exact set-similarity join of text blocks with license templates, in DataFrame functions only.

Two answers per document:

* the places where a known phrase stands word by word, with the first and last
  start (``base``), and
* the templates that are contained in a text block: at least ``CONTAINMENT`` of a
  template's distinct words occur in one block of ``BLOCK`` words.  Blocks start
  every ``STRIDE`` words, so a passage of up to ``STRIDE`` words lies in one block.
  Templates of more words than that have blocks and strides of their own, doubled
  until the template fits, so a document that quotes it holds it in one block.

The join is exact.  Words are ordered by how often they occur in all texts, rarest
first.  With a = ceil(CONTAINMENT * |T|), a block that contains a words of T holds
at least one of the first |T| - a + 1 of them (prefix), has at least a template
words (length), and a common word at place i of T and j of the block leaves room
for 1 + min(|T| - i, |B| - j) >= a common words (position).  What passes is verified.

At volume: three scans, and one more for each further length class of the templates; no text is shuffled.  Word counts fold map-side and only
for template words; documents without a prefix word leave before blocks are cut;
the templates are a parameter of a few hundred words, so their side of the join is
small by definition.  Only matches (document, template) are shuffled.

Defined cases: null counts as empty and has no label; repeated rows get the same
result; rows that share an id but not the text are told apart; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, functions as F

from daygrain.llm.common import GAP_PATTERN, WORD_PATTERN

CONTAINMENT = 0.85
BLOCK, STRIDE = 48, 24

#: Phrases whose places are counted, and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Fixed wording of common license notices, by label.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0"),
    ("all-rights-reserved", "all rights reserved"),
)


def folded(text: Column) -> Column:
    """Lower case for comparing with ASCII words; the Kelvin sign must not become a k."""
    return F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212A"), F.lit("\u0138")))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(folded(text), F.lit(WORD_PATTERN), F.lit(0))


def phrase_pattern(phrase: str) -> str:
    """The words of a phrase, any gaps between them, as whole words in any ASCII case."""
    word = WORD_PATTERN.removesuffix("+")
    return f"(?i)(?<!{word}){GAP_PATTERN.join(phrase.split())}(?!{word})"


def base_places(text: Column, phrases: Mapping[str, str]) -> dict[str, Column]:
    """n_base, first_word, last_word and base_labels (an array) of a text."""
    patterns = {p: phrase_pattern(p) for p in phrases}
    # One class of first letters before the patterns: most places of a text are left at their first character.
    letters = re.escape("".join(sorted({p.split()[0][0] for p in phrases})))
    some = text.rlike(f"(?i)(?=[{letters}])(?:{'|'.join(patterns.values())})")

    def pieces(p: str) -> Column:
        return F.split(text, patterns[p], -1)

    def count(column: Column) -> Column:
        return F.regexp_count(column, F.lit(WORD_PATTERN))

    none = F.lit(None).cast("long")
    n = {p: F.size(pieces(p)) - 1 for p in phrases}
    first = {p: F.when(n[p] > 0, count(pieces(p)[0])) for p in phrases}
    last = {p: F.when(n[p] > 0, count(F.array_join(F.slice(pieces(p), F.lit(1), n[p]), " "))
                      + (n[p] - 1) * len(p.split())) for p in phrases}
    found = F.array_sort(F.array_distinct(F.filter(
        F.array(*[F.when(n[p] > 0, F.lit(label)) for p, label in phrases.items()]), lambda x: x.isNotNull())))
    return {
        "n_base": F.when(some, reduce(Column.__add__, n.values())).otherwise(0).cast("long"),
        "first_word": F.when(some, F.array_min(F.array(*first.values())).cast("long")).otherwise(none),
        "last_word": F.when(some, F.array_max(F.array(*last.values())).cast("long")).otherwise(none),
        "base_labels": F.when(some, found).otherwise(F.array().cast("array<string>")),
    }


def word_counts(docs: DataFrame, vocabulary: Sequence[str], text_col: str) -> dict[str, int]:
    """How often each template word occurs in all texts."""
    found = (docs.select(F.explode(words_of(F.col(text_col))).alias("word")).where(F.col("word").isin(*vocabulary))
             .groupBy("word").count().collect())  # a row per template word
    return {w: 0 for w in vocabulary} | {r["word"]: r["count"] for r in found}


def stride_of(words: int) -> int:
    """The stride of a template of so many words: ``STRIDE``, doubled until it fits."""
    return STRIDE << max(0, ceil(words / STRIDE) - 1).bit_length()


def _contained(docs: DataFrame, id_col: str, text_col: str, sides: DataFrame, by_rank: Sequence[str], prefix: Sequence[int],
               stride: int) -> DataFrame:
    """(id, print, label, share): the templates of ``sides`` contained in blocks of two strides."""
    known = F.array(*map(F.lit, by_rank))
    rare = F.array(*[F.lit(by_rank[r]) for r in prefix])

    def ranks_of_blocks(words: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(words) - 1, F.lit(stride))
        ranks = F.transform(starts, lambda s: F.array_sort(F.transform(
            F.array_intersect(known, F.slice(words, s + 1, BLOCK // STRIDE * stride)),
            lambda w: F.array_position(known, w).cast("int") - 1)))
        return F.when(F.arrays_overlap(words, rare), ranks)

    # The words have a name inside a list of one, so that a text is split once for the test and the blocks.
    blocks = F.transform(F.array(words_of(F.col(text_col))), ranks_of_blocks)
    cut = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("print"), F.explode(blocks).alias("blocks"))
    ranked = cut.select("id", "print", F.explode("blocks").alias("ranks"))
    probes = ranked.select("id", "print", F.col("ranks").alias("own"), F.posexplode("ranks").alias("j", "rank"))
    room = 1 + F.least(F.size("ranks") - F.col("i"), F.size("own") - F.col("j") - 1)
    near = probes.join(sides, "rank").where((F.size("own") >= F.col("least")) & (room >= F.col("least")))
    common = F.size(F.array_intersect("ranks", "own"))
    return (near.withColumn("common", common).where(F.col("common") >= F.col("least"))
            .select("id", "print", "label", (F.col("common") / F.size("ranks")).alias("share")))


def template_matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     templates: Sequence[tuple[str, str]] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """(id, print, label, share): the best containment of each label found in a document."""
    sets = [(label, sorted(set(text.split())), stride_of(len(text.split()))) for label, text in templates if text.split()]
    vocabulary = sorted({w for _, words, _ in sets for w in words})
    counts = word_counts(docs, vocabulary, text_col)
    by_rank = sorted(vocabulary, key=lambda w: (counts[w], w))
    rank = {w: i for i, w in enumerate(by_rank)}
    found = []
    for stride in sorted({stride for _, _, stride in sets}):
        rows = []
        for number, (label, words, own) in enumerate(sets):
            ranks, least = sorted(rank[w] for w in words), ceil(containment * len(words) - 1e-9)
            if own == stride:
                rows += [(r, i, number, label, ranks, least) for i, r in enumerate(ranks[:len(ranks) - least + 1], 1)]
        sides = docs.sparkSession.createDataFrame(
            rows, "rank int, i int, template int, label string, ranks array<int>, least int")
        found.append(_contained(docs, id_col, text_col, sides, by_rank, sorted({row[0] for row in rows}), stride))
    if not found:
        return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("print"), F.lit("").alias("label"),
                           F.lit(0.0).alias("share")).where(F.lit(False))
    return reduce(DataFrame.unionAll, found).groupBy("id", "print", "label").agg(F.max("share").alias("share"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         phrases: Mapping[str, str] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES,
         containment: float = CONTAINMENT) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("print"),
                       F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long").alias("n_words"),
                       *[c.alias(name) for name, c in base_places(text, phrases).items()])
    found = (template_matches(docs, id_col, text_col, templates, containment).groupBy("id", "print")
             .agg(F.collect_set("label").alias("more"), F.max("share").alias("share")))
    b, f = base.alias("b"), found.alias("f")
    joined = b.join(f, F.col("b.id").eqNullSafe(F.col("f.id")) & (F.col("b.print") == F.col("f.print")), "left")
    none = F.array().cast("array<string>")
    return joined.select(
        "b.id", "n_words", "n_base", "first_word", "last_word", "base_labels",
        F.array_sort(F.array_union("base_labels", F.coalesce("more", none))).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"))
