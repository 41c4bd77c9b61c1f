"""Duplicates hidden by formatting: one record per text pair, with its number of copies.

Byte-identical rows are collapsed first, with counts; only the distinct survivors are
brought to canonical form (letters and digits of both texts, case ignored, the two sides
in either order), and those are grouped on their full canonical text, adding the counts.

Groups are only ever aggregated, never gathered: a group holding a third of all rows is
combined before each shuffle, and its members are found by joining on the rare key table
(``lookup_join`` splits hot keys).

Rows with a null text, or one without letter or digit, take no part. Repeated key values
of ``id_col`` count as further copies of the smallest id and are not listed as copies of
themselves. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.text import has_words, squeezed
from corpusloom.staging import lookup_join, stage


def _digest(a: Column, b: Column) -> Column:
    return F.unhex(F.md5(F.concat(F.length(a).cast("string"), F.lit(":"), a, b)))


@dataclass
class Duplicates:
    rows: DataFrame  # id, raw
    survivors: DataFrame  # raw, id, copies, canonical: one per byte-identical pair
    groups: DataFrame  # canonical, keep, copies: one per record

    def records(self) -> DataFrame:
        """(keep_line_no, copies): every record once."""
        return self.groups.select(F.col("keep").alias("keep_line_no"), "copies")

    def copies(self) -> DataFrame:
        """(keep_line_no, copy_line_no): every further row of a record."""
        # Staged, as the lookup join counts it before it reads it.
        repeated = stage(self.groups.filter("copies > 1").select("canonical", "keep", F.col("copies").alias("group_copies")), "repeated")
        kept = stage(lookup_join(self.survivors, repeated, "canonical", weight="group_copies").select("raw", "id", "copies", "keep"), "kept")
        variants = kept.filter("id <> keep").select("keep", "id")
        members = lookup_join(self.rows, kept.filter("copies > 1").select("raw", F.col("id").alias("first"), "keep", "copies"), "raw", weight="copies")
        return variants.unionByName(members.filter("id <> first").select("keep", "id")).toDF("keep_line_no", "copy_line_no").distinct()


def formatting_duplicates(pairs: DataFrame, id_col: str = "line_no", src: str = "src_text", tgt: str = "tgt_text") -> Duplicates:
    taken = pairs.filter(has_words(F.col(src)) & has_words(F.col(tgt))).select(F.col(id_col).alias("id"), F.col(src).alias("src"), F.col(tgt).alias("tgt"))
    collapsed = taken.groupBy("src", "tgt").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    a, b = squeezed(F.col("src")), squeezed(F.col("tgt"))
    survivors = stage(
        collapsed.select("id", "copies", _digest(F.col("src"), F.col("tgt")).alias("raw"), a.alias("a"), b.alias("b")).select(
            "id", "copies", "raw", F.least("a", "b").alias("first"), F.greatest("a", "b").alias("second")
        ),
        "survivors",
    )
    groups = survivors.groupBy("first", "second").agg(F.min("id").alias("keep"), F.sum("copies").alias("copies"))
    canonical = _digest(F.col("first"), F.col("second")).alias("canonical")
    return Duplicates(
        taken.select("id", _digest(F.col("src"), F.col("tgt")).alias("raw")),
        survivors.select("raw", "id", "copies", canonical),
        groups.select(canonical, "keep", "copies"),
    )
