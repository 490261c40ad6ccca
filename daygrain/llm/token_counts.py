"""Token counts as delta-maintained rollups.

A ledger holds, for every committed batch, the signed entries of that batch
(document, source, lang, tokenizer, tokens, +1 or -1 documents) and the totals
after it.  A batch of changes (``upsert`` or ``delete`` of a document's count under
one tokenizer version) is turned into signed entries: what the ledger holds of
the changed documents leaves with a minus, what is wanted enters with a plus, and
what cancels out is dropped.  The totals by source, language and tokenizer
version are the previous totals plus the sums of the entries; nothing is counted
again.

A batch is committed when its marker is complete, which is written last.  A
committed batch is never applied twice: ``commit`` returns False and changes
nothing.  A batch that broke off left no marker; its files are written over.

At volume: texts are read once, where they are counted.  A batch shuffles its own
changes and, of the ledger, the small entries of the changed documents.  Totals
fold map-side, so one source may hold any share of the rows.  One writer at a
time is assumed.

Defined cases: a null text has no tokens; null ids, sources and languages are
values of their own; of several changes to one document and tokenizer in a
batch the one with the highest ``seq`` counts (ties: the highest count, then source and
language), so repeated rows count once; deleting what is not held does nothing;
an empty batch is committed and leaves the totals as they are; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from daygrain.llm.common import SPACED_PATTERN, ship

#: Tokenizer versions that are patterns: runs of non-blanks; runs of letters, of digits, of other signs.
PATTERNS = {"words-1": SPACED_PATTERN, "pieces-1": r"\p{L}+|\p{N}+|[^\x20\x09-\x0D\p{L}\p{N}]+"}
ENTRY = "id long, source string, lang string, tokenizer string, n_docs long, n_tokens long"
KEYS = ["source", "lang", "tokenizer"]


def counted(docs: DataFrame, patterns: Mapping[str, str] = PATTERNS, id_col: str = "doc_id", text_col: str = "text",
            source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """(id, source, lang, tokenizer, n_tokens): one row per row of ``docs`` and pattern."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    counts = F.array(*[F.struct(F.lit(version).alias("tokenizer"),
                                F.regexp_count(text, F.lit(pattern)).cast("long").alias("n_tokens"))
                       for version, pattern in patterns.items()])
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).alias("source"),
                       F.col(lang_col).alias("lang"), F.inline(counts))


def vocabulary_counted(docs: DataFrame, version: str, path: str, id_col: str = "doc_id", text_col: str = "text",
                       source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """As ``counted``, with the tokenizer file ``path`` (a ``tokenizers`` JSON), shipped to the executors."""
    ship(docs.sparkSession)
    with open(path, encoding="utf-8") as file:
        sent = docs.sparkSession.sparkContext.broadcast(file.read())  # a few megabytes, whatever the corpus
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).alias("source"),
                       F.col(lang_col).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer
        tokenizer = Tokenizer.from_str(sent.value)
        tokenizer.encode_special_tokens = True
        for batch in batches:
            n = [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([version] * len(n), pa.string()), pa.array(n, pa.int64())],
                names=["id", "source", "lang", "tokenizer", "n_tokens"])

    return rows.mapInArrow(run, "id long, source string, lang string, tokenizer string, n_tokens long")


class Ledger:
    """Signed entries and totals below ``root``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def batches(self) -> list[str]:
        """Committed batches in commit order."""
        done = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/commits/*/_SUCCESS")
        found = done.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(done)
        names = [status.getPath().getParent().getName() for status in found or []]
        return [name.split("-", 1)[1] for name in sorted(names)]

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens after the last committed batch."""
        done = self.batches()
        if not done:
            return self.spark.createDataFrame([], "source string, lang string, tokenizer string, n_docs long, n_tokens long")
        return self.spark.read.parquet(f"{self.root}/totals/{done[-1]}")

    def entries(self) -> DataFrame:
        """All signed entries of committed batches."""
        paths = [f"{self.root}/entries/{name}" for name in self.batches()]
        return self.spark.read.schema(ENTRY).parquet(*paths) if paths else self.spark.createDataFrame([], ENTRY)

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply ``changes`` (op, id, source, lang, tokenizer, n_tokens, seq) unless the batch is committed already."""
        done = self.batches()
        if batch in done:
            return False
        fields = F.struct("seq", "n_tokens", "source", "lang", "op")
        last = changes.groupBy("id", "tokenizer").agg(F.max(fields).alias("c")).select("id", "tokenizer", "c.*")
        wanted = last.where("op = 'upsert'").select(
            "id", "source", "lang", "tokenizer", F.lit(1).cast("long").alias("n_docs"),
            F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"))
        parts = [wanted]
        if done:
            e, k = self.entries().alias("e"), last.select("id", "tokenizer").alias("k")
            held = e.join(k, F.col("e.id").eqNullSafe(F.col("k.id")) & (F.col("e.tokenizer") == F.col("k.tokenizer")),
                          "left_semi")
            parts.append(held.withColumns({c: -F.col(c) for c in ("n_docs", "n_tokens")}))
        delta = (reduce(DataFrame.unionByName, parts).groupBy("id", *KEYS)
                 .agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
                 .where("n_docs <> 0 OR n_tokens <> 0"))
        delta.select("id", *KEYS, "n_docs", "n_tokens").write.mode("overwrite").parquet(f"{self.root}/entries/{batch}")
        added = self.spark.read.schema(ENTRY).parquet(f"{self.root}/entries/{batch}").drop("id")
        (self.totals().unionByName(added).groupBy(*KEYS)
         .agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 OR n_tokens <> 0")
         .write.mode("overwrite").parquet(f"{self.root}/totals/{batch}"))
        (self.spark.range(1).select(F.lit(batch).alias("batch"))
         .write.mode("overwrite").parquet(f"{self.root}/commits/{len(done):09d}-{batch}"))
        return True
