"""Evaluation passages inside documents, by a BM25 index of the test items.

Each item has two texts, question and answer. They are put into an inverted index with
BM25 weights: postings in compressed rows, with the maxima of blocks of ``BLOCK`` texts.
Every document is cut into overlapping passages of ``2 * run`` words, each the query of a
block-max WAND search. One without ``run`` words that are all in the index, and whose
largest weights reach the threshold, is skipped. The terms of the others are taken by their largest weight; those whose weights together don't reach the threshold can't retrieve anything alone, so only
the blocks in the postings of the other terms are candidates. Of these, the ones whose
summed block maxima reach the block's threshold are scored, and the texts that reach
their own threshold are retrieved, however many.

The thresholds lose nothing: a text's threshold is the lowest score that any ``run``
successive words of that text have against it, and two neighbouring passages share
``run - 1`` words, so a document with such a run has a passage that scores as much.
Texts with like thresholds make a tier with postings of its own, so that a text which
is easily reached doesn't lower the bar for the others. What is retrieved is checked for
a common run of ``run`` words in question and answer.

One index serves all items in one pass over the documents, up to ``MAX_CHARS`` characters
of items (0.5 GB of index); more are divided by a hash into as many passes as needed,
which bounds what is broadcast and what the driver holds. Items with fewer than ``run``
words in both texts can't leak. Null texts have no words; repeated items and documents
are reported once each. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN = 12
BLOCK = 8
MAX_CHARS = 100_000_000
K1, B = 1.2, 0.75
#: Words handled at once, which bounds a worker's memory; so do the cells of a chunk of passages.
WORDS_AT_ONCE = 400_000
CELLS = 2_000_000
_SLACK = 1e-3
#: Thresholds within this factor share a tier.
_TIER = 1.5
_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def word_lists(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts, in order, and the number of each text.

    A text that begins or ends with a separator has no empty word there.
    """
    split = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\pL\pN]+")
    flat, sizes = split.flatten(), pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    word = pc.not_equal(flat, "")
    upto = np.concatenate([[0], np.cumsum(word.to_numpy(zero_copy_only=False))])
    ends = np.cumsum(sizes)
    return flat.filter(word), upto[ends] - upto[ends - sizes]


@dataclass
class Tier:
    """Postings of some texts. Keys are term * width + block, or term * texts + text, sorted."""

    text: np.ndarray  # the tier's texts, by rising threshold
    threshold: np.ndarray
    block_threshold: np.ndarray
    term_max: np.ndarray  # the last is for unknown words
    first: np.ndarray  # term -> its first block posting
    block_key: np.ndarray
    block_max: np.ndarray
    text_key: np.ndarray
    weight: np.ndarray


@dataclass
class Index:
    vocabulary: pa.Array
    tiers: list[Tier]
    owners: list[tuple[str, str]]  # text -> (item, "question" or "answer")
    words: np.ndarray  # the terms of all texts in order
    run_key: np.ndarray  # hashes of (run, text), sorted
    run_at: np.ndarray  # where each run begins in ``words``


def _hashed(terms: np.ndarray, text: np.ndarray) -> np.ndarray:
    """One number per row of terms and its text."""
    h = (text.astype(np.uint64) + np.uint64(1)) * _STEP
    for k in range(terms.shape[1]):
        h = (h ^ (h >> np.uint64(29))) * _MIX + (terms[:, k].astype(np.uint64) + np.uint64(1)) * _STEP
    return h ^ (h >> np.uint64(32))


def _places(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted key stands among sorted keys, and whether it does."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _tier(text: np.ndarray, threshold: np.ndarray, term: np.ndarray, of: np.ndarray, weight: np.ndarray, terms: int) -> Tier:
    """``text`` by rising threshold; postings (term, of, weight) of any texts."""
    place = np.full(int(max(of.max(), text.max())) + 1, -1, np.int64)
    place[text] = np.arange(len(text))
    mine = place[of] >= 0
    term, at, weight = term[mine], place[of[mine]], weight[mine]
    n, width = len(text), -(-len(text) // BLOCK)
    order = np.lexsort((at, term))
    term, at, weight = term[order], at[order], weight[order]
    key = term * width + at // BLOCK
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    block_key, block_max = key[starts], np.maximum.reduceat(weight, starts)
    term_max = np.zeros(terms + 1, np.float32)
    np.maximum.at(term_max, term[starts], block_max)
    first = np.searchsorted(block_key, np.arange(terms + 2) * width)
    return Tier(text, threshold[text], np.minimum.reduceat(threshold[text], np.arange(0, n, BLOCK)), term_max, first, block_key, block_max, term * n + at, weight)


def build_index(items: list[tuple[str, str | None, str | None]], run: int = RUN) -> Index | None:
    """The index of (item, question, answer) rows, or None where no text has a whole run."""
    texts, owners = [], []
    for item, question, answer in items:
        for kind, text in (("question", question), ("answer", answer)):
            if text:
                texts.append(text)
                owners.append((item, kind))
    flat, sizes = word_lists(pa.array(texts, pa.string()))
    long = sizes >= run
    if not long.any():
        return None
    flat, sizes = flat.filter(pa.array(np.repeat(long, sizes))), sizes[long]
    owners = [o for o, k in zip(owners, long.tolist()) if k]
    vocabulary = pc.unique(flat)
    ids = pc.index_in(flat, value_set=vocabulary).to_numpy(zero_copy_only=False).astype(np.int64)
    n, v = len(sizes), len(vocabulary)
    of = np.repeat(np.arange(n), sizes)
    pairs, place, tf = np.unique(of * v + ids, return_inverse=True, return_counts=True)
    term, text = pairs % v, pairs // v
    df = np.bincount(term, minlength=v)
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    weight = (idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[text] / sizes.mean()))).astype(np.float32)

    begins = np.cumsum(sizes) - sizes
    at = np.flatnonzero(np.arange(len(ids)) - begins[of] <= sizes[of] - run)
    sums, keys = np.empty(len(at), np.float32), np.empty(len(at), np.uint64)
    own = weight[place]
    for k in range(0, len(at), WORDS_AT_ONCE):
        window = at[k : k + WORDS_AT_ONCE, None] + np.arange(run)
        terms = ids[window]
        keys[k : k + len(window)] = _hashed(terms, of[window[:, 0]])
        order = np.argsort(terms, axis=1, kind="stable")
        terms, w = np.take_along_axis(terms, order, 1), np.take_along_axis(own[window], order, 1)
        w[:, 1:][terms[:, 1:] == terms[:, :-1]] = 0
        sums[k : k + len(window)] = w.sum(1)
    threshold = np.minimum.reduceat(sums, np.searchsorted(of[at], np.arange(n))) * np.float32(1 - _SLACK)

    order = np.argsort(threshold, kind="stable")
    level = np.floor(np.log(threshold[order] / threshold[order[0]]) / np.log(_TIER)).astype(int)
    tiers = [_tier(part, threshold, term, text, weight, v) for part in np.split(order, np.flatnonzero(np.diff(level)) + 1)]
    by_key = np.argsort(keys, kind="stable")
    return Index(vocabulary, tiers, owners, ids.astype(np.int32), keys[by_key], at[by_key])


def _retrieved(tier: Tier, distinct: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(passage, text) pairs that reach the text's threshold; ``distinct`` has a passage's terms, unknown ones last in number."""
    width, n = len(tier.block_threshold), len(tier.text)
    most = tier.term_max[distinct]
    order = np.argsort(most, axis=1)
    terms, most = np.take_along_axis(distinct, order, 1).astype(np.int64), np.take_along_axis(most, order, 1)
    upto = np.cumsum(most, axis=1)
    leading = upto >= tier.threshold[0]
    rest = np.where(leading, 0, upto).max(1)
    r, c = np.nonzero(leading)
    begin = tier.first[terms[r, c]]
    count = tier.first[terms[r, c] + 1] - begin
    posting = np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum())
    if not len(posting):
        return posting, posting
    cell = np.repeat(r, count) * width + tier.block_key[posting] % width
    if len(posting) * 4 < len(distinct) * width:
        found, place = np.unique(cell, return_inverse=True)
        bound = np.bincount(place, tier.block_max[posting])
    else:
        bound = np.bincount(cell, tier.block_max[posting])
        found = np.flatnonzero(bound)
        bound = bound[found]
    p, block = found // width, found % width
    need = tier.block_threshold[block] - 1e-4
    near = bound + rest[p] >= need
    p, block, bound, need = p[near], block[near], bound[near], need[near]
    for k in range(terms.shape[1]):
        some = np.flatnonzero(~leading[p, k] & (most[p, k] > 0))
        if len(some):
            at, there = _places(tier.block_key, terms[p[some], k] * width + block[some])
            bound[some] += np.where(there, tier.block_max[at], 0)
    near = bound >= need
    p, block = p[near], block[near]
    text = block[:, None] * BLOCK + np.arange(BLOCK)
    inside = text < n
    p, text = np.repeat(p, inside.sum(1)), text[inside]
    score = np.zeros(len(p))
    for k in range(terms.shape[1]):
        some = np.flatnonzero(most[p, k] > 0)
        if len(some):
            at, there = _places(tier.text_key, terms[p[some], k] * n + text[some])
            score[some] += np.where(there, tier.weight[at], 0)
    reached = score >= tier.threshold[text] - 1e-4
    return p[reached], tier.text[text[reached]]


def _with_run(index: Index, terms: np.ndarray, p: np.ndarray, text: np.ndarray, run: int) -> np.ndarray:
    """Which of the (passage, text) pairs have a run of words in common."""
    common = np.zeros(len(p), bool)
    for k in range(terms.shape[1] - run + 1):
        window = terms[p, k : k + run]
        at, there = _places(index.run_key, _hashed(window, text))
        some = np.flatnonzero(there)
        begin = index.run_at[at[some]]
        common[some] |= (index.words[begin[:, None] + np.arange(run)] == window[some]).all(1)
    return common


def search(index: Index, flat: pa.Array, sizes: np.ndarray, run: int = RUN) -> Iterator[tuple[int, int]]:
    """(document position, text) for each document and indexed text with a common run."""
    unknown = len(index.vocabulary)
    ids = pc.fill_null(pc.index_in(flat, value_set=index.vocabulary), unknown).to_numpy(zero_copy_only=False).astype(np.int32)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    count = np.where(sizes >= run, np.maximum(1, -(-(sizes - run + 1) // (run + 1))), 0)
    of = np.repeat(np.arange(len(sizes)), count)
    if not len(of):
        return
    step = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    start = begins[of] + step * (run + 1)
    stop = np.minimum(start + 2 * run, ends[of])
    padded = np.concatenate([ids, np.full(2 * run, unknown, np.int32)])
    strange = np.concatenate([[0], np.cumsum(ids == unknown)])
    known = strange[run:] == strange[:-run]
    for tier in index.tiers:
        total = np.concatenate([[0.0], np.cumsum(tier.term_max[ids], dtype=np.float64)])
        strong = (total[run:] - total[:-run] >= tier.threshold[0] - 1e-6) & known
        upto = np.concatenate([[0], np.cumsum(strong)])
        alive = np.flatnonzero(upto[stop - run + 1] > upto[start])
        rows = max(1, min(2000, CELLS // max(1, len(tier.block_threshold))))
        for at in range(0, len(alive), rows):
            some = alive[at : at + rows]
            terms = padded[start[some][:, None] + np.arange(2 * run)]
            terms[np.arange(2 * run) >= (stop - start)[some][:, None]] = unknown
            distinct = np.sort(terms, axis=1)
            distinct[:, 1:][distinct[:, 1:] == distinct[:, :-1]] = unknown
            p, text = _retrieved(tier, distinct)
            common = _with_run(index, terms, p, text, run)
            yield from zip(of[some[p[common]]].tolist(), text[common].tolist())


def leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "sample_id", question: str = "source_text", answer: str = "reference_text", run: int = RUN, max_chars: int = MAX_CHARS) -> DataFrame:
    """(doc_id, item_id, in_question, in_answer): the documents that hold a run of an item."""
    spark = documents.sparkSession
    wanted = items.filter(F.col(item_id).isNotNull()).select(item_id, question, answer).distinct()
    chars = wanted.agg(F.sum(F.coalesce(F.length(question), F.lit(0)) + F.coalesce(F.length(answer), F.lit(0)))).first()[0] or 0
    # Slices by hash differ in size, so more of them are made than would just do.
    slices = 1 if chars <= max_chars else -(-chars * 5 // (max_chars * 4))
    kind = documents.schema[doc_id].dataType.simpleString()
    schema = f"`{doc_id}` {kind}, `{item_id}` string, in_question boolean, in_answer boolean"
    found = None
    for k in range(slices):
        rows = wanted.filter(F.pmod(F.xxhash64(item_id), F.lit(slices)) == k).orderBy(item_id).collect()
        index = build_index([(str(r[0]), r[1], r[2]) for r in rows], run)
        if index is None:
            continue
        shared = spark.sparkContext.broadcast(index)

        def look(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                texts = batch.column(1)
                size = np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False))
                begin = 0
                while begin < batch.num_rows:
                    limit = 5 * WORDS_AT_ONCE + (size[begin - 1] if begin else 0)
                    end = max(begin + 1, int(np.searchsorted(size, limit)))
                    flat, sizes = word_lists(texts.slice(begin, end - begin))
                    hits: dict[tuple[int, str], list[bool]] = {}
                    for d, t in search(index, flat, sizes, run):
                        item, side = index.owners[t]
                        hits.setdefault((begin + d, item), [False, False])[side == "answer"] = True
                    at_, named = [d for d, _ in hits], [i for _, i in hits]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(at_, pa.int64())), pa.array(named, pa.string()), pa.array([h[0] for h in hits.values()], pa.bool_()), pa.array([h[1] for h in hits.values()], pa.bool_())],
                        [doc_id, item_id, "in_question", "in_answer"],
                    )
                    begin = end

        part = documents.select(doc_id, text).mapInArrow(look, schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], schema)
    return found.groupBy(doc_id, item_id).agg(F.max("in_question").alias("in_question"), F.max("in_answer").alias("in_answer"))
