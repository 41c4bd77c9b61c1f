"""Texts of varying length put into windows of fixed capacity, with little unused space.

Sizes are counted in tokens of a public tokenizer. Only a text longer than the window is
cut, into full windows and a rest that is packed like a text. Packing is best-two-fit: a
bin is filled greedily with the longest that still fits; then, if two unpacked pieces
fill the bin better than its smallest piece does, they take that one's place.

Pieces are packed in shards of about ``SHARD`` documents, chosen by a hash of the id, so
a task never holds more; each shard leaves at most a few bins that aren't full. Texts are
read once, whole; only (id, size) is packed. Null and empty texts have no tokens and get
one row without a bin.
"""

from __future__ import annotations

import base64
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.staging import stage

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: how byte-level BPE cuts a text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SHARD = 20_000
MAX_WINDOWS = 200

_encoders: dict = {}


def encoder(ranks: bytes):
    """The tokenizer of a rank file's content; kept for a worker's next task."""
    import tiktoken

    if (found := _encoders.get(hash(ranks))) is None:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        found = _encoders[hash(ranks)] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})
    return found


def token_counts(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens); the tokenizer's file is read here and sent to the workers."""
    with open(tokenizer, "rb") as f:
        shared = documents.sparkSession.sparkContext.broadcast(f.read())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(shared.value).encode_ordinary
        for batch in batches:
            sizes = [len(tokens(t.as_py() or "")) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], [doc_id, "n_tokens"])

    kind = documents.schema[doc_id].dataType.simpleString()
    return documents.select(doc_id, text).mapInArrow(count, f"`{doc_id}` {kind}, n_tokens bigint")


def best_two_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each piece; all sizes are between 1 and the capacity."""
    order = np.argsort(sizes, kind="stable")
    begin = np.searchsorted(sizes[order], np.arange(capacity + 2))
    left = np.diff(begin)  # how many pieces of each size are unpacked
    cursor = begin.copy()
    bins = np.empty(len(sizes), np.int64)
    remaining, number = len(sizes), 0
    while remaining:
        distinct = np.flatnonzero(left)
        present = distinct.tolist()
        gap, inside = capacity, []
        at = len(present) - 1
        while gap and (at := bisect_right(present, gap, 0, at + 1) - 1) >= 0:
            size = present[at]
            if left[size] == 0:
                at -= 1
                continue
            left[size] -= 1
            inside.append(size)
            gap -= size
        if gap and len(inside) > 1:
            smallest = inside[-1]
            room = gap + smallest
            distinct = distinct[(left[distinct] > 0) & (distinct < room)]
            if len(distinct):
                second = np.searchsorted(distinct, room - distinct, "right") - 1
                second -= (second == np.arange(len(distinct))) & (left[distinct] < 2)
                both = np.where(second >= 0, distinct + distinct[second], 0)
                k = int(both.argmax())
                if both[k] > smallest:
                    left[smallest] += 1
                    inside[-1:] = [int(distinct[k]), int(distinct[second[k]])]
                    left[inside[-1]] -= 1
                    left[inside[-2]] -= 1
        for size in inside:
            bins[order[cursor[size]]] = number
            cursor[size] += 1
        remaining -= len(inside)
        number += 1
    return bins


def pack(counts: DataFrame, windows: DataFrame, doc_id: str = "doc_id", shard: int = SHARD) -> DataFrame:
    """(window_name, capacity_tokens, doc_id, n_tokens, piece_no, token_start, piece_tokens, bin_id).

    ``counts`` has the id and ``n_tokens``; ``windows`` a ``window_name`` and
    ``capacity_tokens``, those of null or no capacity being left out. A repeated
    (id, size), or window, counts once. Up to ``MAX_WINDOWS`` windows go into one plan;
    more are divided by a hash into as many parts as needed.
    """
    sized = stage(counts.select(doc_id, "n_tokens").distinct(), "sized")
    shards = max(1, -(-sized.count() // shard))
    kind = sized.schema[doc_id].dataType.simpleString()
    usable = windows.filter("capacity_tokens > 0").select(F.col("window_name").cast("string").alias("window_name"), F.col("capacity_tokens").cast("int").alias("capacity_tokens")).distinct()
    n = usable.count()
    slices = 1 if n <= MAX_WINDOWS else -(-n * 2 // MAX_WINDOWS)
    per_window = sized.withColumns({"window_name": F.lit(""), "capacity_tokens": F.lit(0), "_full": F.lit(0)}).filter(F.lit(False))
    for k in range(slices):
        own = usable.filter(F.pmod(F.xxhash64("window_name", "capacity_tokens"), F.lit(slices)) == k).orderBy("window_name", "capacity_tokens").collect()
        if own:
            literal = F.array(*(F.struct(F.lit(w[0]).alias("window_name"), F.lit(w[1]).alias("capacity_tokens")) for w in own))
            full = F.floor(F.col("n_tokens") / F.col("capacity_tokens")).cast("int")
            per_window = per_window.unionByName(sized.select(doc_id, "n_tokens", F.inline(literal)).withColumn("_full", full))
    rest = F.col("n_tokens") - F.col("_full") * F.col("capacity_tokens")
    columns = ["window_name", "capacity_tokens", doc_id, "n_tokens", "piece_no", "token_start", "piece_tokens", "bin_id"]

    whole = per_window.filter("_full > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("_full") - 1)).alias("piece_no")).select(
        *columns[:5],
        (F.col("piece_no").cast("bigint") * F.col("capacity_tokens")).alias("token_start"),
        F.col("capacity_tokens").cast("bigint").alias("piece_tokens"),
        F.concat_ws("-", "window_name", F.lit("full"), doc_id, "n_tokens", "piece_no").alias("bin_id"),
    )
    empty = per_window.filter("n_tokens = 0").select(*columns[:4], F.lit(0).alias("piece_no"), F.lit(0).cast("bigint").alias("token_start"), F.lit(0).cast("bigint").alias("piece_tokens"), F.lit(None).cast("string").alias("bin_id"))
    pieces = per_window.filter(rest > 0).select(
        *columns[:4],
        F.col("_full").alias("piece_no"),
        (F.col("n_tokens") - rest).alias("token_start"),
        rest.cast("bigint").alias("piece_tokens"),
        F.pmod(F.xxhash64(doc_id, "n_tokens"), F.lit(shards)).cast("int").alias("_shard"),
    )

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values([doc_id, "n_tokens"], kind="stable")
        bins = best_two_fit(group["piece_tokens"].to_numpy(), int(group["capacity_tokens"].iloc[0]))
        prefix = f"{group['window_name'].iloc[0]}-{group['_shard'].iloc[0]}-"
        return group.assign(bin_id=[prefix + str(b) for b in bins.tolist()])[columns]

    schema = f"window_name string, capacity_tokens int, `{doc_id}` {kind}, n_tokens bigint, piece_no int, token_start bigint, piece_tokens bigint, bin_id string"
    packed = pieces.groupBy("window_name", "capacity_tokens", "_shard").applyInPandas(fill, schema)
    return whole.unionByName(empty).unionByName(packed)


def bins(packed: DataFrame) -> DataFrame:
    """(window_name, bin_id, pieces, used_tokens, fill) of each bin."""
    return (
        packed.filter("bin_id is not null")
        .groupBy("window_name", "bin_id", "capacity_tokens")
        .agg(F.count("*").alias("pieces"), F.sum("piece_tokens").alias("used_tokens"))
        .select("window_name", "bin_id", "pieces", "used_tokens", F.round(F.col("used_tokens") / F.col("capacity_tokens"), 6).alias("fill"))
    )


def faults(packed: DataFrame, counts: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(window_name, texts, overfull, cut_though_fitting, tokens_lost): what any packing must have as 0 but for ``texts``.

    Per window: the texts it covers, bins above capacity, texts in more pieces than the
    capacity asks for, and tokens of ``counts`` that are in no piece or in two.
    """
    filled = packed.filter("bin_id is not null").groupBy("window_name", "capacity_tokens", "bin_id").agg(F.sum("piece_tokens").alias("used"))
    overfull = filled.groupBy("window_name").agg(F.count_if(F.col("used") > F.col("capacity_tokens")).alias("overfull"))
    per_text = packed.groupBy("window_name", "capacity_tokens", doc_id, "n_tokens").agg(F.count("*").alias("pieces"), F.sum("piece_tokens").alias("packed"))
    wanted = F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / F.col("capacity_tokens")))
    texts = per_text.groupBy("window_name").agg(F.count("*").alias("texts"), F.count_if(F.col("pieces") > wanted).alias("cut_though_fitting"), F.sum("packed").alias("packed"))
    total = counts.distinct().agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    lost = F.abs(F.lit(total) - F.col("packed"))
    return texts.join(overfull, "window_name", "left").select("window_name", "texts", F.coalesce("overfull", F.lit(0)).alias("overfull"), "cut_though_fitting", lost.alias("tokens_lost"))
