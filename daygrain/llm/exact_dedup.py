"""Exact dedup by deterministic block naming.

A text without its white space is cut into blocks of ``block_points`` code
points.  The distinct blocks are sorted and numbered, so that equal blocks and
only they have one integer name.  Then adjacent names of a document are paired,
the distinct pairs are sorted and numbered again, and so on until each document
has one name.  Two documents are equal exactly if they need as many levels and
end with the same name.

At volume: blocks travel once, folded map-side, to be sorted and numbered.
Documents find the names of their blocks by a 128-bit address of the block; the
sort proves that no two blocks share an address, and if two ever did, that
level would join on the blocks themselves.  Pairs of names join on the names.
All joins are one hot side against unique keys, which AQE splits; a document's
own list of names is the only thing gathered in one row.  Names are stored in
the shared folder, so a lost executor cannot renumber them.

Defined cases: null counts as empty, all empty texts are equal.  Rows that
repeat an id and an equal text are one document: they carry the same result,
all count in ``group_size``, and ``deduplicate`` keeps the longest of them
once.  Rows that share an id but not the text are told apart.  A null id loses
ties.  Extra columns and clashing names are kept by ``deduplicate``; an empty
table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from daygrain.llm.common import packed
from daygrain.session import stored

BLOCK_POINTS = 4096
#: The characters that do not count: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\v\f\r"
LAST = -1


def without_blanks(text: Column) -> Column:
    """The text without ASCII white space; null gives the empty text."""
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), BLANKS, F.coalesce(text, F.lit("")))


def blocks_of(text: Column, block_points: int) -> Column:
    """Consecutive blocks of code points; the empty text is one empty block."""
    parts = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block_points}}}"), F.lit(0))
    return F.when(F.length(text) <= block_points, F.array(text)).otherwise(parts)


def address(block: Column) -> list[Column]:
    return [F.xxhash64(block).alias("h1"), F.xxhash64(F.lit(1), block).alias("h2")]


def numbered(distinct: DataFrame, *order: str) -> DataFrame:
    """An integer name per row: rows are sorted inside their hash partition, partitions own disjoint ranges."""
    return distinct.sortWithinPartitions(*order).withColumn("name", F.monotonically_increasing_id())


def _name_blocks(texts: DataFrame, prints: DataFrame, block_points: int) -> DataFrame:
    """(id, sha, seq): the names of each document's blocks, in order."""
    blocks = texts.select(F.explode(blocks_of(F.col("norm"), block_points)).alias("block"))
    names = numbered(blocks.select(*address(F.col("block")), "block").distinct(), "block").select("h1", "h2", "name")
    names = stored(names, "blocks")
    shared = names.groupBy("h1", "h2").count().where("count > 1")
    if shared.isEmpty():
        places = prints.select("id", "sha", F.posexplode("addresses").alias("pos", "a")).select(
            "id", "sha", "pos", F.col("a.h1").alias("h1"), F.col("a.h2").alias("h2"))
        return _sequences(places.join(names, ["h1", "h2"]))
    # Two blocks share an address: names and joins go by the blocks themselves.
    whole = stored(numbered(blocks.distinct(), "block"), "blocks")
    places = texts.select("id", "sha", F.posexplode(blocks_of(F.col("norm"), block_points)).alias("pos", "block"))
    return _sequences(places.join(whole, "block"))


def _sequences(places: DataFrame) -> DataFrame:
    """Gather the names of a document; repeated rows of a document fold."""
    placed = F.array_sort(F.collect_set(F.struct("pos", "name")))
    return stored(places.groupBy("id", "sha").agg(F.transform(placed, lambda x: x["name"]).alias("seq")), "names")


def _pair_level(open_rows: DataFrame) -> DataFrame:
    """One level up: name adjacent pairs; a last name without a partner pairs with ``LAST``."""
    pairs = F.transform(F.sequence(F.lit(0), F.size("seq") - 1, F.lit(2)), lambda i: F.struct(
        F.get("seq", i).alias("a"), F.coalesce(F.get("seq", i + 1), F.lit(LAST)).alias("b")))
    places = open_rows.select("id", "sha", F.posexplode(pairs).alias("pos", "p")).select(
        "id", "sha", "pos", F.col("p.a").alias("a"), F.col("p.b").alias("b"))
    names = stored(numbered(places.select("a", "b").distinct(), "a", "b"), "pairs")
    return _sequences(places.join(names, ["a", "b"]))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            block_points: int = BLOCK_POINTS) -> DataFrame:
    """One row per row of ``docs``: id, n_points, sha (of the text without blanks), keep_id, group_size."""
    texts = docs.select(F.col(id_col).alias("id"), F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("n_points"),
                        without_blanks(F.col(text_col)).alias("norm")).withColumn("sha", F.sha2("norm", 256))
    prints = stored(texts.select("id", "n_points", "sha", F.transform(
        blocks_of(F.col("norm"), block_points), lambda b: F.struct(*address(b))).alias("addresses")), "prints")
    level, open_rows = 0, _name_blocks(texts, prints, block_points)
    ended = []
    while True:
        ended.append(open_rows.where(F.size("seq") == 1).select(
            "id", "sha", F.lit(level).alias("level"), F.col("seq")[0].alias("name")))
        open_rows = open_rows.where(F.size("seq") > 1)
        if open_rows.isEmpty():
            break
        level, open_rows = level + 1, _pair_level(open_rows)
    names = reduce(DataFrame.unionAll, ended)
    rows = stored(prints.select("id", "n_points", "sha").alias("r").join(
        names.alias("n"), F.col("r.id").eqNullSafe(F.col("n.id")) & (F.col("r.sha") == F.col("n.sha"))).select(
        "r.id", "r.n_points", "r.sha", "n.level", "n.name"), "rows")
    # Stored, so that both sides of the join are read: a group that holds a third of all rows can then be split.
    groups = stored(rows.groupBy("level", "name").agg(
        F.max_by("id", F.struct("n_points", -F.col("id"))).alias("keep_id"), F.count("*").alias("group_size")), "groups")
    return rows.join(groups, ["level", "name"]).select("id", "n_points", "sha", "keep_id", "group_size")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                block_points: int = BLOCK_POINTS) -> DataFrame:
    """``docs`` with one row of each group of equal texts."""
    found = classes(docs, id_col, text_col, block_points)
    stays = found.where(F.col("id").eqNullSafe(F.col("keep_id"))).select(
        F.col("id").alias("_k_id"), F.col("sha").alias("_k_sha")).distinct()
    keyed = packed(docs, id=F.col(id_col), sha=F.sha2(without_blanks(F.col(text_col)), 256),
                   points=F.length(F.col(text_col)))
    kept = keyed.join(stays, keyed["id"].eqNullSafe(stays["_k_id"]) & (keyed["sha"] == stays["_k_sha"]), "left_semi")
    once = Window.partitionBy("id", "sha").orderBy(F.col("points").desc())
    return kept.withColumn("rank", F.row_number().over(once)).where("rank = 1").select("_row.*")
