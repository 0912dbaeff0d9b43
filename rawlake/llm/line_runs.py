"""Line dedup: levelled sorted runs of line hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rawlake.llm.common import SPACE, ascii_lower, hash_pair, stage, text_of

KEY = ["h1", "h2"]
# Working columns beside those of the documents.
ROW, DROP, PARTS = ["__line_row1", "__line_row2"], "__line_drop", "__line_parts"


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


class LineRuns:
    """Runs of (key, documents, owner), sorted by key, on levels.

    Batches come in falling order of document id, so the first batch that has a key holds
    its owner, the document with the largest id. When a level has ``fanout`` runs they are
    merged into one run of the next level; a key is looked up in few runs only.
    """

    def __init__(self, spark: SparkSession, fanout: int = 3):
        self.spark = spark
        self.fanout = fanout
        self.levels: list[list[DataFrame]] = []

    def runs(self) -> list[DataFrame]:
        return [run for held in self.levels for run in held]

    def add(self, lines: DataFrame) -> None:
        """Add a batch of (h1, h2, id): its new keys with their owner, its known keys as counts only."""
        # one row per key and document before the count, so that a very common line is spread
        batch = lines.select(*KEY, "id").distinct().groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("owner"))
        known = None
        for run in self.runs():
            keys = run.select(*KEY)
            known = keys if known is None else known.unionByName(keys)
        if known is not None:
            batch = stage(batch)
            fresh = batch.join(known.hint("merge"), KEY, "left_anti")
            again = batch.join(known.hint("merge"), KEY, "left_semi")
            batch = fresh.unionByName(again.withColumn("owner", F.lit(None).cast(batch.schema["owner"].dataType)))
        self._put(0, batch)

    def _put(self, at: int, run: DataFrame) -> None:
        while len(self.levels) <= at:
            self.levels.append([])
        self.levels[at].append(stage(run.sortWithinPartitions(*KEY)))
        if len(self.levels[at]) >= self.fanout:
            merged = self._merged(self.levels[at])
            self.levels[at] = []
            self._put(at + 1, merged)

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        rows = runs[0]
        for run in runs[1:]:
            rows = rows.unionByName(run)
        return rows.groupBy(*KEY).agg(F.sum("n").alias("n"), F.max("owner").alias("owner"))

    def merged(self) -> DataFrame:
        """All keys with their documents and owner."""
        return self._merged(self.runs())


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 40,
    min_docs: int = 5,
    batches: int = 4,
    fanout: int = 3,
) -> DataFrame:
    """Documents without the lines that many of them share.

    A line's key is the line without white space at its ends, A-Z in lower case. A key of at
    least ``min_chars`` code points, found in at least ``min_docs`` documents, keeps its lines
    only in the largest id that holds it. Keys are compared by 128-bit hashes. Null and empty
    texts are one empty line. Rows of one id count as one document, as do all rows with a null
    id, which is below every other. All columns of ``docs`` come back with the new text, plus
    ``n_lines`` and ``n_dropped``, which replace columns of those names.
    """
    spark = docs.sparkSession
    ident = F.col(id_col)
    row = hash_pair(ident, text_of(text_col))
    parts = F.split(text_of(text_col), "\n")
    fractions = [i / batches for i in range(1, batches)]
    cuts = docs.agg(F.percentile_approx(ident, fractions).alias("at")).first()["at"] or []
    exploded = docs.select(ident.alias("id"), row[0].alias("r1"), row[1].alias("r2"), F.posexplode(parts).alias("pos", "line"))
    # no trimmed line is longer than the line itself
    keyed = exploded.where(F.length("line") >= min_chars).withColumn("key", line_key(F.col("line"))).where(F.length("key") >= min_chars)
    h1, h2 = hash_pair(F.col("key"))
    above = sum(((F.col("id") > c).cast("int") for c in cuts), F.lit(0))
    # batch 0 has the largest ids, the last one the smallest and null ids
    batch = F.lit(len(cuts)) - F.coalesce(above, F.lit(0))
    lines = stage(keyed.select("id", "r1", "r2", "pos", h1.alias("h1"), h2.alias("h2"), batch.alias("batch")), "batch")

    runs = LineRuns(spark, fanout)
    for b in range(len(cuts) + 1):
        runs.add(lines.where(F.col("batch") == b).select(*KEY, "id"))
    common = stage(runs.merged().where(F.col("n") >= min_docs).select(*KEY, "owner"))

    hit = lines.join(common, KEY).where(~F.col("id").eqNullSafe(F.col("owner")))
    drops = hit.groupBy("r1", "r2").agg(F.collect_set("pos").alias(DROP))
    drops = drops.withColumnsRenamed({"r1": ROW[0], "r2": ROW[1]})
    out = docs.drop("n_lines", "n_dropped").withColumns(dict(zip(ROW, row, strict=True)))
    out = out.join(drops, ROW, "left")
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(DROP))
    kept = F.array_join(F.transform(left, lambda i: F.get(F.col(PARTS), i)), "\n")
    none = F.col(DROP).isNull()
    out = out.withColumn(PARTS, parts).withColumns(
        {
            text_col: F.when(none, text_of(text_col)).otherwise(kept),
            "n_lines": F.size(PARTS).cast("bigint"),
            "n_dropped": F.when(none, 0).otherwise(F.size(DROP)).cast("bigint"),
        }
    )
    return out.drop(*ROW, DROP, PARTS)
