"""Records of evaluation splits that also appear, exactly or almost, in training.

Records are canonicalised (case, punctuation and white space gone) to their bag of words,
and the bag is hashed: evaluation hashes joined with training hashes give the exact
overlaps. Almost equal bags are found between distinct bags only, one representative per
class of equal records, and without loss: two bags with enough words in common share one
of the first words of each, when the words of all bags are put in one fixed order, rare
words first (prefix filter); they are joined on that word and a level of their sizes; from
that word on enough words are left; and their 128-bit sketches differ in no more places
than the bags may (each word flips one bit). The few pairs that pass all are checked on
their whole bags. A word that is among the first of more than ``FREQUENT`` classes is
joined together with a second word in common, as single words grow frequent with the rows;
in bags of more than ``PAIRED`` words, and those near them in size, it is joined alone. Frequent words and classes are split on both sides of their joins.

The order of words uses the ``ORDERED_WORDS`` most frequent words of all rows, a bounded
broadcast; all others count as rare and are ordered by their hash. Any order is lossless;
this one keeps the candidates few. Members are expanded only at the end.

Rows with a text that is null or without letter or digit take no part, nor do rows of no
known split; repeated rows of one id count once. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from hashlib import md5

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.text import has_words, words
from corpusloom.staging import fits, grid_join, lookup_join, stage

ORDERED_WORDS = 20_000
PERCENT = 85
PAIRED = 128
FREQUENT, MAX_FREQUENT = 20, 50_000
EVALUATION, TRAINING = ("dev", "test"), "train"
SKETCH_BITS = 128


def token(word: str, k: int) -> int:
    """The k-th occurrence of a word in a bag, as 64 bits; a bag is then a set of these."""
    return xxhash.xxh3_64_intdigest(f"{word}\x01{k}") - (1 << 63)


def prefix_length(n: int, percent: int, common: int = 2) -> int:
    """How many first words must hold ``common`` words of any bag that is near enough."""
    return min(n, n - math.ceil(n * percent / 100 - 1e-9) + common)


def sketch(tokens: list[int]) -> tuple[int, int]:
    """Two signed 64-bit halves in which each token flips one bit."""
    bits = 0
    for t in tokens:
        bits ^= 1 << (t % SKETCH_BITS)
    return (bits >> 64) - (1 << 63), (bits & ((1 << 64) - 1)) - (1 << 63)


def keyed(found: list[str], ranks: dict[str, int]) -> list[tuple[int, int, str]]:
    """The occurrences of sorted words as (rank, occurrence, word)."""
    out, last, k = [], None, 0
    for w in found:
        k = k + 1 if w == last else 1
        last = w
        out.append((ranks.get(w, -1), k, w))
    return out


def _digest(found: list[str]) -> bytes:
    return md5(" ".join(found).encode()).digest()


def _bags(rows: DataFrame, rank: dict[str, int], percent: int) -> DataFrame:
    """(id, split, bag, n, prefix, high, low) of (id, split, src, tgt)."""
    shared = rows.sparkSession.sparkContext.broadcast(rank)

    def bag_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = shared.value
        for batch in batches:
            bags, sizes, prefixes, high, low = [], [], [], [], []
            for src, tgt in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                found = sorted([*words(src), *words(tgt)])
                bags.append(_digest(found))
                sizes.append(len(found))
                # Later occurrences are rarer than the first; rare words have the rank -1 and go by their hash.
                tokens = [t for _, _, t in sorted((r, -k, token(w, k)) for r, k, w in keyed(found, ranks))]
                prefixes.append(tokens[: prefix_length(len(found), percent)])
                halves = sketch(tokens)
                high.append(halves[0])
                low.append(halves[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(bags, pa.binary()), pa.array(sizes, pa.int32()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(high, pa.int64()), pa.array(low, pa.int64())],
                ["id", "split", "bag", "n", "prefix", "high", "low"],
            )

    return rows.mapInArrow(bag_up, "id string, split string, bag binary, n int, prefix array<bigint>, high bigint, low bigint")


def _tokens(rows: DataFrame) -> DataFrame:
    """(bag, tokens) of (src, tgt)."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted([*words(a), *words(b)]) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            sets = [[token(w, k) for _, k, w in keyed(f, {})] for f in found]
            yield pa.RecordBatch.from_arrays([pa.array(map(_digest, found), pa.binary()), pa.array(sets, pa.list_(pa.int64()))], ["bag", "tokens"])

    return rows.select("src", "tgt").mapInArrow(tokens, "bag binary, tokens array<bigint>")


@dataclass
class Overlap:
    members: DataFrame  # id, split, bag: every row once
    exact: DataFrame  # bag: classes in both splits
    near: DataFrame  # eval_bag, train_bag, common, longer

    def _links(self) -> DataFrame:
        """(eval_bag, train_bag, exact): classes that overlap."""
        same = self.exact.select(F.col("bag").alias("eval_bag"), F.col("bag").alias("train_bag"), F.lit(True).alias("exact"))
        return same.unionByName(self.near.select("eval_bag", "train_bag", F.lit(False).alias("exact")))

    def pairs(self) -> DataFrame:
        """(eval_id, train_id, eval_split, exact) of all overlapping rows; classes with many members are split on both sides."""
        evaluation = self.members.filter(F.col("split").isin(*EVALUATION)).select(F.col("bag").alias("eval_bag"), F.col("id").alias("eval_id"), F.col("split").alias("eval_split"))
        training = self.members.filter(F.col("split") == TRAINING).select(F.col("bag").alias("train_bag"), F.col("id").alias("train_id"))
        linked = stage(grid_join(evaluation, self._links(), "eval_bag").drop("eval_bag"), "linked")
        return grid_join(linked, training, "train_bag").filter("eval_id <> train_id").select("eval_id", "train_id", "eval_split", "exact")

    def records(self) -> DataFrame:
        """(id, split, class_id, links): every row with its class of equal records, named by the smallest id, and its links.

        The links of an evaluation row are the classes with training rows that overlap it,
        those of a training row the classes with evaluation rows; its own may be among them.
        """
        links = self._links()
        counts = (
            links.groupBy(F.col("eval_bag").alias("bag"))
            .agg(F.count("*").alias("as_eval"))
            .join(links.groupBy(F.col("train_bag").alias("bag")).agg(F.count("*").alias("as_train")), "bag", "full")
        )
        named = self.members.groupBy("bag").agg(F.min("id").alias("class_id"), F.count("*").alias("members"))
        classes = stage(named.join(counts, "bag", "left"), "named")
        links_of = F.when(F.col("split") == TRAINING, F.col("as_train")).otherwise(F.col("as_eval"))
        return lookup_join(self.members, classes, "bag", weight="members").select("id", "split", "class_id", F.coalesce(links_of, F.lit(0)).alias("links"))

    def overlapping_evaluation(self) -> DataFrame:
        """(id, split, exact): each evaluation row that overlaps, without expanding pairs."""
        classes = stage(self._links().groupBy(F.col("eval_bag").alias("bag")).agg(F.max("exact").alias("exact")), "overlapping")
        return lookup_join(self.members.filter(F.col("split").isin(*EVALUATION)), classes, "bag").groupBy("id", "split").agg(F.max("exact").alias("exact"))


def clean_split(split: Column) -> Column:
    return F.lower(F.trim(split))


def split_overlap(rows: DataFrame, id_col: str = "sample_id", src: str = "src_text", tgt: str = "tgt_text", split: str = "split", percent: int = PERCENT, ordered_words: int = ORDERED_WORDS, paired: int = PAIRED, frequent: int = FREQUENT) -> Overlap:
    taken = rows.select(F.col(id_col).alias("id"), clean_split(F.col(split)).alias("split"), F.col(src).alias("src"), F.col(tgt).alias("tgt")).filter(
        F.col("id").isNotNull() & F.col("split").isin(TRAINING, *EVALUATION) & has_words(F.col("src")) & has_words(F.col("tgt"))
    )
    counts = (
        taken.select(F.explode(F.regexp_extract_all(F.lower(F.concat_ws(" ", "src", "tgt")), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("word"))
        .groupBy("word")
        .count()
        .orderBy(F.desc("count"), "word")
        .limit(ordered_words)
        .collect()
    )
    rank = {r["word"]: k for k, r in enumerate(reversed(counts))}
    bags = stage(_bags(taken, rank, percent).withColumn("row", F.monotonically_increasing_id()), "bags")
    members = bags.select("id", "split", "bag").distinct()

    # A class of equal bags goes by the number of its first row, which is short in a shuffle.
    evaluated = F.col("split") != TRAINING
    groups = bags.groupBy("bag").agg(F.min("row").alias("row"), F.max(evaluated).alias("in_eval"), F.max(~evaluated).alias("in_train"))
    classes = stage(groups.join(bags.drop("bag"), "row").withColumnRenamed("row", "class"), "classes")
    exact = classes.filter("in_eval and in_train").select("bag")

    # Sizes that are near enough lie in the same or in neighbouring levels.
    level = F.floor(F.log("n") / max(1.01 * math.log(100 / percent), 0.001)) if percent < 100 else F.col("n")

    own = {"train": F.array(level), "eval": F.array(level - 1, level, level + 1)}

    words_of = ("class", "n", "high", "low")

    def singles(side: str, *more: str) -> DataFrame:
        """The first words of one side's classes, without the one more that pairs of words need."""
        at = classes.filter(f"in_{side}").select(*words_of, "prefix", F.explode(own[side]).alias("level"))
        first = at.select(*words_of, *more, "level", F.posexplode(F.slice("prefix", F.lit(1), F.size("prefix") - 1)).alias("at", "word"))
        return first.withColumn("key", F.xxhash64("word", "level"))

    hot = reduce(DataFrame.unionByName, [singles(s).groupBy("key").agg(F.count("*").alias("rows")).filter(F.col("rows") > frequent) for s in own])
    hot = stage(hot.groupBy("key").agg(F.max("rows").alias("rows")).orderBy(F.desc("rows"), "key").limit(MAX_FREQUENT).select("key"), "frequent")

    def named(rows: DataFrame, side: str, key: str = "key", left: Column | None = None) -> DataFrame:
        over = F.col("n") - F.col("at") if left is None else left
        return rows.select(F.col(key).alias("key"), over.alias(f"{side}_left"), *[F.col(c).alias(f"{side}_{c}") for c in words_of])

    def rare(side: str) -> DataFrame:
        return named(singles(side).join(F.broadcast(hot), "key", "left_anti"), side)

    def paired_up(side: str) -> DataFrame:
        """Frequent words with each further word; alone in long bags and those near them in size."""
        marked = singles(side, "prefix").join(F.broadcast(hot), "key")
        further = F.transform(F.slice("prefix", F.col("at") + 2, F.size("prefix")), lambda w, k: F.struct(F.xxhash64("key", w).alias("key"), (F.col("n") - F.col("at") - k).alias("left")))
        pairs = marked.filter(F.col("n") <= paired).select(*words_of, F.explode(further).alias("k"))
        return named(pairs, side, "k.key", F.col("k.left")).unionByName(named(marked.filter(F.col("n") * 100 >= paired * percent), side))

    joined = rare("eval").join(rare("train"), "key")
    if not fits(hot, 0):
        joined = joined.unionByName(grid_join(paired_up("eval"), paired_up("train"), "key"))

    longer, shorter = F.greatest("eval_n", "train_n"), F.least("eval_n", "train_n")
    least = F.ceil(longer * percent / 100)
    differing = F.bit_count(F.col("eval_high").bitwiseXOR(F.col("train_high"))) + F.bit_count(F.col("eval_low").bitwiseXOR(F.col("train_low")))
    # From the first words in common on, no more words can be in common than either bag has left.
    left_over = F.least("eval_left", "train_left")
    candidates = (
        joined.filter((shorter * 100 >= longer * percent) & (left_over >= least) & (F.col("eval_class") != F.col("train_class")) & (differing <= F.col("eval_n") + F.col("train_n") - 2 * least))
        .select("eval_class", "train_class", longer.alias("longer"))
        .distinct()
    )
    candidates = stage(candidates, "candidates")
    wanted = candidates.select(F.col("eval_class").alias("class")).union(candidates.select("train_class")).distinct().join(classes.select("class", "bag", "id", "split"), "class")
    wanted = stage(wanted, "wanted")
    whole = _tokens(taken.join(wanted.select("id", "split"), ["id", "split"], "left_semi")).join(wanted.select("class", "bag"), "bag").groupBy("class", "bag").agg(F.first("tokens").alias("tokens"))
    whole = stage(whole, "whole")
    half = stage(grid_join(candidates, whole.toDF("eval_class", "eval_bag", "a"), "eval_class", unique=True).drop("eval_class"), "half")
    near = (
        grid_join(half, whole.toDF("train_class", "train_bag", "b"), "train_class", unique=True)
        .withColumn("common", F.size(F.array_intersect("a", "b")))
        .filter(F.col("common") * 100 >= F.col("longer") * percent)
        .select("eval_bag", "train_bag", "common", "longer")
    )
    return Overlap(members, exact, stage(near, "near"))
