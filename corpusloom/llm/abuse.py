"""Abusive, hateful or sexual passages, told by compression distance.

Two zstandard dictionaries are trained, one on abusive and one on ordinary text. A window
of words is abusive if it gets shorter with the abusive dictionary: its score is its
compressed length with the ordinary dictionary less that with the abusive one, in bytes.
A document's score is that of its highest window. The threshold is calibrated on labelled
documents that the dictionaries compared have not seen, and on the number of unlabelled
documents with each score, for flagged ones are more frequent among the labelled.

Labels say only that a document holds such a passage, and some are wrong. The passages
for the abusive dictionary are cut from windows of flagged documents with several word
pairs that are far more frequent in flagged documents than in others: from the first to
the last such pair. From a flagged document without such a window those are taken that
are novel: half of the unflagged documents make a dictionary with which they stay longer
than any window of ``NOVEL`` of the other half. The ordinary dictionary takes the windows
of other documents that have no such pair; those among them that a first pair of
dictionaries finds abusive are given more weight in a second training. Words are compared after disguises are undone:
case, zero-width characters, digits and signs for letters, letters set apart or repeated.

The fit takes at most ``MAX_LABELLED`` labelled documents, chosen by a hash of their id,
of at most ``MAX_LABELLED_CHARS`` characters each, and all of their windows (at this bound
2.4 GB and 160 s on the driver); every document is scored, and every window of it. Documents whose labels disagree, or have none, are no examples. Without
enough examples of both kinds nothing can be told: all scores are null. Null, blank or
wordless texts have a null score and are not flagged.
"""

from __future__ import annotations

import math
import random
import re
import sys
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.staging import stage

MAX_LABELLED = 6_000
MAX_LABELLED_CHARS = 20_000
#: Parts of the labelled documents, of which one at a time is held out until so many flagged ones were scored.
CALIBRATION_SHARE, CALIBRATION_FLAGGED = 4, 150
#: Share of ordinary documents without a window that counts as novel.
NOVEL = 0.95
WINDOW, STEP = 10, 4
DICTIONARY_BYTES = 256 * 1024
LEVEL = 3
#: Log odds of a word pair in a passage that serves as an example, and above which a window isn't ordinary.
TELLING, SUSPECT = 2.5, 1.5
#: Bytes from which an ordinary window counts as hard, and how often it is then repeated.
HARD, REPEATS = 4, 10

ZERO_WIDTH = re.compile("[­​-‏⁠﻿]")
TOKEN = re.compile(r"[\w@$]+")
LETTERS = re.compile(r"[^\W\d_]+")
REPEATED = re.compile(r"([^\W\d_])\1{2,}")
#: Single letters in a row that are taken for one word.
APART = 4
#: Tokens whose words a worker remembers.
REMEMBERED = 300_000
#: Signs that stand for letters.
STANDS_FOR = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"})


_known: dict[str, list[str]] = {}


def _token_words(token: str) -> list[str]:
    """The words of a run of letters, digits, signs and underscores."""
    letters = LETTERS.findall(token)
    if letters and letters[0] != token:
        parts = token.split("_")
        if len(parts) >= APART and all(len(p) < 2 for p in parts):
            token = "".join(parts)
        letters = [w for p in token.split("_") for w in LETTERS.findall(p.translate(STANDS_FOR) if LETTERS.search(p) else p)]
    return [REPEATED.sub(r"\1", w) for w in letters]


def plain_words(text: str) -> list[str]:
    """Lower-case words of letters, with disguises undone; numbers are left out."""
    if len(_known) > REMEMBERED:
        _known.clear()
    text = text.lower()
    if not text.isascii() and ZERO_WIDTH.search(text):
        text = ZERO_WIDTH.sub("", text)
    out, apart = [], 0
    for token in TOKEN.findall(text):
        words = _known.get(token)
        if words is None:
            words = _known[token] = _token_words(token)
        if len(token) == 1 and words:
            apart += 1
        elif apart:
            if apart >= APART:
                out[-apart:] = [REPEATED.sub(r"\1", "".join(out[-apart:]))]
            apart = 0
        out += words
    if apart >= APART:
        out[-apart:] = [REPEATED.sub(r"\1", "".join(out[-apart:]))]
    return out


def windows(words: list[str]) -> list[str]:
    if len(words) <= WINDOW:
        return [" ".join(words)] if words else []
    return [" ".join(words[i : i + WINDOW]) for i in range(0, len(words) - WINDOW + STEP, STEP)]


def _pair_odds(documents: list[list[str]], labels: list[int]) -> dict[tuple[str, str], float]:
    """Log odds of the word pairs that at least two flagged documents have."""
    flagged, others = Counter(), Counter()
    for words, label in zip(documents, labels):
        if label:
            flagged.update(set(zip(words, words[1:])))
    flagged = {pair: k for pair, k in flagged.items() if k > 1}
    for words, label in zip(documents, labels):
        if not label:
            others.update(flagged.keys() & set(zip(words, words[1:])))
    n1 = sum(labels)
    n0 = len(labels) - n1
    return {pair: math.log((k + 0.3) / (n1 + 0.6)) - math.log((others[pair] + 0.3) / (n0 + 0.6)) for pair, k in flagged.items()}


def _dictionary(samples: list[str]) -> bytes:
    encoded = [s.encode() for s in samples]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, encoded).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on
        return b"\n".join(encoded)[-DICTIONARY_BYTES:]


@dataclass
class Model:
    abusive: bytes
    ordinary: bytes
    threshold: float = 0.0
    held: list[tuple[int, int]] = field(default_factory=list)  # scores and labels of held-out documents

    def compressors(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        made = []
        for content in (self.abusive, self.ordinary):
            d = zstandard.ZstdCompressionDict(content)
            d.precompute_compress(level=LEVEL)
            made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        return made[0], made[1]


def score(text: str | None, abusive: zstandard.ZstdCompressor, ordinary: zstandard.ZstdCompressor) -> int | None:
    best, a, o = None, abusive.compress, ordinary.compress
    for window in windows(plain_words(text or "")):
        b = window.encode()
        got = len(o(b)) - len(a(b))
        if best is None or got > best:
            best = got
    return best


def _novelty(documents: list[list[str]]) -> tuple[Callable[[bytes], bytes], int] | None:
    """A compressor made from half of these documents, and the length that few of the others have a window of."""
    half = [w for words in documents[::2] for w in windows(words)]
    if not half or len(documents) < 2:
        return None
    compress = Model(content := _dictionary(half), content).compressors()[0].compress
    longest = sorted(max((len(compress(w.encode())) for w in windows(words)), default=0) for words in documents[1::2])
    return compress, longest[min(len(longest) - 1, int(len(longest) * NOVEL))]


def _train(documents: list[list[str]], labels: list[int]) -> Model | None:
    odds = _pair_odds(documents, labels)
    abusive, ordinary, untold = [], [], []
    for words, label in zip(documents, labels):
        before = len(abusive)
        for window in windows(words):
            w = window.split()
            each = [odds.get(p, -9.0) for p in zip(w, w[1:])]
            if not label and max(each, default=-9.0) < SUSPECT:
                ordinary.append(window)
            elif label and sum(x > TELLING for x in each) > 2:
                at = [i for i, x in enumerate(each) if x > SUSPECT]
                abusive.append(" ".join(w[at[0] : at[-1] + 2]))
        if label and len(abusive) == before:
            untold.append(words)
    if untold and (novelty := _novelty([words for words, label in zip(documents, labels) if not label])):
        compress, cut = novelty
        abusive += [w for words in untold for w in windows(words) if len(compress(w.encode())) >= cut]
    if not abusive or not ordinary:
        return None
    shuffled = random.Random(7)
    shuffled.shuffle(abusive)
    shuffled.shuffle(ordinary)
    first = Model(_dictionary(abusive), _dictionary(ordinary))
    a, o = (c.compress for c in first.compressors())
    hard = [x for x in ordinary for b in [x.encode()] if len(o(b)) - len(a(b)) >= HARD]
    return Model(first.abusive, _dictionary(hard * REPEATS + ordinary)) if hard else first


def _threshold(scores: list[tuple[int, int]]) -> float:
    """The middle of the thresholds whose F1 is next to the best."""
    flagged = sum(label for _, label in scores)
    by = []
    for t in range(1, max([s for s, _ in scores], default=0) + 1):
        taken = [label for s, label in scores if s >= t]
        by.append((2 * sum(taken) / max(1, len(taken) + flagged), t))
    best = max(by, default=(0, 1))[0]
    near = [t for f1, t in by if f1 >= 0.99 * best]
    return float(near[len(near) // 2]) if near else 1.0


def calibrated(held: list[tuple[int, int]], unlabelled: dict[int, int]) -> float:
    """A threshold for all documents, by the number of unlabelled ones with each score.

    Flagged documents are far more frequent among the labelled ones, for which a lower
    threshold would be best. High scores are taken to be right: at the score that half of
    the flagged held-out documents reach, the number of unlabelled documents says how many
    stand behind each of them. Lower scores are taken in while, by that measure, at least a
    third of the documents they add are right.
    """
    flagged = [s for s, label in held if label]
    reached = lambda t: sum(s >= t for s in flagged)
    above = lambda t: sum(n for s, n in unlabelled.items() if s >= t)
    sure = max((t for t in set(flagged) if t >= 1 and reached(t) * 2 >= reached(1)), default=0)
    if not sure or not above(sure):
        return _threshold(held)
    each = above(sure) / reached(sure)
    return float(max(range(1, sure + 1), key=lambda t: (3 * each * reached(t) - above(t), t)))


def fit(examples: list[tuple[str, int]]) -> Model | None:
    """A model of (text, label) examples in a fixed order, or None if they are too few."""
    words = [[sys.intern(w) for w in plain_words(t)] for t, _ in examples]
    labels = [y for _, y in examples]
    final = _train(words, labels)
    scores: list[tuple[int, int]] = []
    for fold in range(CALIBRATION_SHARE):
        trial = _train([w for k, w in enumerate(words) if k % CALIBRATION_SHARE != fold], [y for k, y in enumerate(labels) if k % CALIBRATION_SHARE != fold])
        if trial is not None:
            compressors = trial.compressors()
            scores += [(s, labels[k]) for k in range(fold, len(examples), CALIBRATION_SHARE) if (s := score(examples[k][0], *compressors)) is not None]
        if sum(y for _, y in scores) >= CALIBRATION_FLAGGED:
            break
    if final is None or not scores:
        return None
    final.threshold, final.held = _threshold(scores), scores
    return final


def agreed_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, low, high) of the documents whose labels agree."""
    known = labels.filter("doc_id is not null and flagged is not null")
    return known.groupBy("doc_id").agg(F.min("flagged").alias("low"), F.max("flagged").alias("high")).filter("low = high")


def labelled_examples(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> list[tuple[str, int]]:
    """The bounded sample that the model is fitted on, in the order of a hash of the id."""
    chosen = agreed_labels(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = (
        documents.select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")
        .filter(F.length("text").between(1, MAX_LABELLED_CHARS))
        .select("doc_id", "text", F.col("high").cast("int").alias("label"))
        .toArrow()
        .to_pylist()
    )
    rows.sort(key=lambda r: r["doc_id"])
    random.Random(11).shuffle(rows)
    return [(r["text"], int(r["label"] > 0)) for r in rows]


def abuse_scores(documents: DataFrame, labels: DataFrame, keep: tuple[str, ...] = (), max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, keep..., score, abusive) of every document; ``score`` is relative to the threshold."""
    model = fit(labelled_examples(documents, labels, max_labelled))
    kept = ["doc_id", *keep]
    if model is None:
        return documents.select(*kept, F.lit(None).cast("int").alias("score"), F.lit(False).alias("abusive"))
    schema = ", ".join([*(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in kept), "score int"])
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        compressors = model.compressors()
        for batch in batches:
            scores = [score(t.as_py(), *compressors) for t in batch.column(len(kept))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(kept))), pa.array(scores, pa.int32())], [*kept, "score"])

    rated = stage(documents.select(*kept, "text").mapInArrow(rate, schema), "rated")
    labelled = agreed_labels(labels).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    counts = rated.filter("score is not null").join(F.broadcast(labelled), "doc_id", "left_anti").groupBy("score").count().collect()
    threshold = int(calibrated(model.held, {r["score"]: r["count"] for r in counts}))
    relative = F.col("score") - F.lit(threshold)
    return rated.withColumn("score", relative).withColumn("abusive", F.coalesce(F.col("score") >= 0, F.lit(False)))
