"""Language of texts by a linear-chain conditional random field over words, so that code-switched texts get a label for each word.

A word's features are its hashed byte n-grams with marks at both ends (which makes affixes of them) and its shares in a
lexicon; transitions between labels are learned too. Training draws segments from a bounded number of labelled rows of each
language and strings segments of different languages together, so that switches occur. Labels of words are the marginals
of the forward-backward algorithm over the whole text; the text's language is the one with the largest share.

A batch of texts is one chain in which every text starts anew. The chain is cut into blocks that are run side by side:
first each block's map from the state before to the state behind it, then the states between blocks, then the words inside all blocks.

Defined results: null texts and texts without a letter are ``und`` with score 0, and so is everything if nothing can be learned;
a null doc_id is not held out; rows with null lang teach nothing; repeated rows get equal results; equal shares go to the first label
by code point; an empty table gives no row; further columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BATCH_BYTES, in_batches, slices, table
from .words import LETTERS, cut_words

#: The sample: rows of each language, segments of a row - spread over its whole text - and words of a segment, at most.
SAMPLE_ROWS, SEGMENTS, SEGMENT = 300, 24, 16
#: Words of a training chain.
CHAIN = 48
#: Hashed features, n-gram lengths, occurrences that bring a word of the sample into the lexicon.
FEATURES, GRAMS, LEAST = 1 << 16, (2, 3, 4), 4
#: Rounds, step and penalty of the training.
ROUNDS, STEP, PENALTY = 60, 0.15, 2e-5
#: A word's label is at most e**DEPTH times likelier than another, as far as the word itself tells.
DEPTH = 25.0

_MIX = np.random.default_rng(7).integers(1, 1 << 32, (max(GRAMS) + 1, max(GRAMS)), dtype=np.uint64) | np.uint64(1)


class Model(NamedTuple):
    labels: list[str]
    grams: np.ndarray  #: weights of hashed features by label, a row of zeros behind them
    lexicon: pa.Array
    shares: np.ndarray  #: of a lexicon word in each label, less the even share
    lexical: np.ndarray  #: weights of shares by label
    bias: np.ndarray
    steps: np.ndarray  #: weights of transitions


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def gram_places(known: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(features, begins): feature numbers of every n-gram length at each byte of the marked words, and where each word begins."""
    marked = pc.binary_join_element_wise(*[x if isinstance(x, pa.Array) else pa.scalar(x, pa.large_string()) for x in ("\x02", known.cast(pa.large_string()), "\x03", "")])
    offsets = np.frombuffer(marked.buffers()[1], np.int64)[marked.offset : marked.offset + len(marked) + 1]
    data = np.frombuffer(marked.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].astype(np.uint64)
    begins = (offsets - offsets[0])[:-1]
    left = np.repeat((offsets - offsets[0])[1:], np.diff(offsets)) - np.arange(len(data))
    padded = np.concatenate((data, np.zeros(max(GRAMS), np.uint64)))
    out = np.full((len(GRAMS), len(data)), FEATURES, np.int32)
    for row, n in enumerate(GRAMS):
        h = np.full(len(data), np.uint64(n))
        for j in range(n):
            h += padded[j : j + len(data)] * _MIX[n, j]
            h ^= h >> np.uint64(15)
        h = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - FEATURES.bit_length() + 1)
        out[row, left >= n] = h[left >= n]
    return out, begins


def emissions(model: Model, known: pa.Array) -> np.ndarray:
    """What each distinct word itself says for each label."""
    if not len(known):
        return np.zeros((0, len(model.labels)))
    places, begins = gram_places(known)
    out = np.add.reduceat(sum(model.grams[p] for p in places), begins, axis=0) + model.bias
    at = pc.index_in(known.cast(pa.large_string()), value_set=model.lexicon)
    found = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
    out[found] += model.shares[pc.fill_null(at, 0).to_numpy()[found]] @ model.lexical
    return out


def chain(psi: np.ndarray, start: np.ndarray, step: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Normalised forward states of one chain of words; where ``start`` holds, it begins anew from ``first``."""
    n, k = psi.shape
    if not n:
        return psi
    width = int(np.ceil(np.sqrt(n)))
    blocks = -(-n // width)
    filled = np.ones((blocks * width, k))
    filled[:n] = psi
    anew = np.ones(blocks * width, bool)
    anew[:n] = start
    p, s = filled.reshape(blocks, width, k), anew.reshape(blocks, width)
    maps = np.tile(np.eye(k), (blocks, 1, 1))
    for t in range(width):
        maps = (maps.reshape(-1, k) @ step).reshape(blocks, k, k) * p[:, t, None, :]
        at = np.flatnonzero(s[:, t])
        maps[at] = (first * p[at, t])[:, None, :]
        maps /= maps.sum(axis=(1, 2), keepdims=True)
    state, enter = np.full(k, 1 / k), np.empty((blocks, k))
    for b in range(blocks):
        enter[b] = state
        state = state @ maps[b]
        state /= state.sum()
    out = np.empty((blocks, width, k))
    for t in range(width):
        enter = (enter @ step) * p[:, t]
        at = np.flatnonzero(s[:, t])
        enter[at] = first * p[at, t]
        enter /= enter.sum(axis=1, keepdims=True)
        out[:, t] = enter
    return out.reshape(-1, k)[:n]


def marginals(scores: np.ndarray, start: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """P(label) of each word of a chain, given all words of its text."""
    if not len(scores):
        return scores
    psi = np.exp(np.maximum(scores - scores.max(axis=1, keepdims=True), -DEPTH))
    step, even = np.exp(steps - steps.max()), np.full(psi.shape[1], 1 / psi.shape[1])
    ahead = chain(psi, start, step, even)
    behind = chain(psi[::-1], np.append(start[1:], True)[::-1], step.T, even)[::-1]
    both = ahead * behind / psi
    return both / both.sum(axis=1, keepdims=True)


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS) -> list[tuple[str, list[str]]]:
    """(lang, words) of segments of at most ``rows`` rows of each language."""
    known = docs.where(~held_out() & F.col("lang").isNotNull())
    key = F.xxhash64("doc_id")
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # a row for each language
    if not counts:
        return []
    # a first cut by hash keeps the rows that are ordered few; then exactly the first ``rows``
    rate = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, 2.0 * rows / n + 50.0 / n)))])
    some = known.where(F.pmod(key, F.lit(1 << 20)) < rate[F.col("lang")] * (1 << 20)).select("lang", "text", key.alias("key"), F.xxhash64("text").alias("also"))
    some = some.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("key", "also"))).where(F.col("place") <= rows).select("lang", "text")

    def segments(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches, "text"):
            found = cut_words(batch.column("text"), LETTERS)
            lettered = pc.match_substring_regex(found.known, r"\pL").to_numpy(zero_copy_only=False)
            langs, words = batch.column("lang").to_pylist(), found.known.to_pylist()
            keep = lettered[found.code]
            code, row = found.code[keep], found.row[keep]
            edges = np.searchsorted(row, np.arange(batch.num_rows + 1))
            out = []
            for i, lang in enumerate(langs):
                n = edges[i + 1] - edges[i]
                many = min(SEGMENTS, -(-n // SEGMENT))
                for j in range(many):
                    at = edges[i] + j * n // many
                    out.append((lang, [words[c] for c in code[at : min(at + 1 + (5 * j + n) % SEGMENT, edges[i + 1])]]))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.list_(pa.string()))], names=["lang", "words"])

    return sorted((r.lang, r.words) for r in in_batches(some, segments, "lang string, words array<string>").collect())  # rows * SEGMENTS a language at most


def train(segments: list[tuple[str, list[str]]], rounds: int = ROUNDS) -> Model | None:
    """Maximum likelihood with a quadratic penalty, by Adam over all chains at once."""
    if not segments:
        return None
    labels = sorted({lang for lang, _ in segments})
    k, place = len(labels), {x: i for i, x in enumerate(labels)}
    order = np.random.default_rng(1).permutation(len(segments))
    coded = pa.array([w for i in order for w in segments[i][1]], pa.large_string()).dictionary_encode()
    codes, known = coded.indices.to_numpy(), coded.dictionary
    truth = np.concatenate([np.full(len(segments[i][1]), place[segments[i][0]]) for i in order])
    width = min(CHAIN, len(codes))
    rows = len(codes) // width
    codes, truth = codes[: rows * width].reshape(rows, width), truth[: rows * width].reshape(rows, width)
    seen = np.zeros((len(known), k))
    np.add.at(seen, (codes.ravel(), truth.ravel()), 1)
    often = np.flatnonzero(seen.sum(axis=1) >= LEAST)
    lexicon, shares = known.take(pa.array(often)), seen[often] / seen[often].sum(axis=1, keepdims=True) - 1 / k
    places, begins = gram_places(known)
    lengths = np.diff(begins, append=places.shape[1])
    owner = np.repeat(np.arange(len(known)), lengths)
    weights = {"grams": np.zeros((FEATURES + 1, k)), "lexical": np.zeros((k, k)), "bias": np.zeros(k), "steps": np.zeros((k, k))}
    moments = {x: (np.zeros_like(w), np.zeros_like(w)) for x, w in weights.items()}
    one = np.eye(k)[truth]
    told = one[:, :-1].reshape(-1, k).T @ one[:, 1:].reshape(-1, k)
    words = rows * width
    for turn in range(1, rounds + 1):
        model = Model(labels, weights["grams"], lexicon, shares, weights["lexical"], weights["bias"], weights["steps"])
        e = np.add.reduceat(sum(model.grams[p] for p in places), begins, axis=0) + model.bias
        e[often] += shares @ model.lexical
        psi = np.exp(np.maximum(e - e.max(axis=1, keepdims=True), -DEPTH))[codes]
        step = np.exp(model.steps - model.steps.max())
        ahead, behind, scale = np.empty_like(psi), np.ones_like(psi), np.empty((rows, width))
        for t in range(width):
            a = psi[:, t] if not t else (ahead[:, t - 1] @ step) * psi[:, t]
            scale[:, t] = a.sum(axis=1)
            ahead[:, t] = a / scale[:, t, None]
        for t in range(width - 2, -1, -1):
            behind[:, t] = ((psi[:, t + 1] * behind[:, t + 1]) @ step.T) / scale[:, t + 1, None]
        both = ahead * behind
        both /= both.sum(axis=2, keepdims=True)
        after = (psi[:, 1:] * behind[:, 1:] / scale[:, 1:, None]).reshape(-1, k)
        expected = (ahead[:, :-1].reshape(-1, k).T @ after) * step
        slope = np.zeros((len(known), k))
        np.add.at(slope, codes.ravel(), (both - one).reshape(-1, k))
        each = slope[owner]
        grams = np.stack([np.bincount(places.ravel(), weights=np.tile(each[:, c], len(GRAMS)), minlength=FEATURES + 1) for c in range(k)], axis=1)
        grams[FEATURES] = 0
        slopes = {"grams": grams, "lexical": shares.T @ slope[often], "bias": slope.sum(axis=0), "steps": expected - told}
        for name, g in slopes.items():
            g = g / words + PENALTY * weights[name]
            first, second = moments[name]
            first += 0.1 * (g - first)
            second += 0.01 * (g * g - second)
            weights[name] -= STEP * (first / (1 - 0.9**turn)) / (np.sqrt(second / (1 - 0.99**turn)) + 1e-8)
    return Model(labels, weights["grams"].astype(np.float32), lexicon, shares, weights["lexical"], weights["bias"], weights["steps"])


def label(docs: DataFrame, model: Model | None, spans: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_words; with ``spans`` also the runs of words of one language, in order."""
    out = docs.select("doc_id", held_out().alias("held_out"), "text")
    more = ", spans array<struct<lang:string,words:int>>" if spans else ""
    if model is None:
        rest = [F.array().cast("array<struct<lang:string,words:int>>").alias("spans")] if spans else []
        return out.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("n_words"), *rest)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES weights a language and a lexicon of the sample

    def run(batches: Iterator[pa.RecordBatch]):
        model = sent.value
        names = pa.array(model.labels)
        for batch in slices(batches, "text", max(1 << 16, BATCH_BYTES * 8 // max(8, len(model.labels)))):
            found = cut_words(batch.column("text"), LETTERS)
            lettered = pc.match_substring_regex(found.known, r"\pL").to_numpy(zero_copy_only=False)
            keep = lettered[found.code]
            code, row = found.code[keep], found.row[keep]
            p = marginals(emissions(model, found.known)[code], np.diff(row, prepend=-1) > 0, model.steps)
            words = np.bincount(row, minlength=batch.num_rows)
            sums = np.stack([np.bincount(row, weights=p[:, c], minlength=batch.num_rows) for c in range(len(names))], axis=1)
            best = sums.argmax(axis=1)
            known = words > 0
            score = np.where(known, sums[np.arange(len(sums)), best] / np.maximum(words, 1), 0.0)
            told = pc.if_else(pa.array(known), names.take(pa.array(best)), pa.scalar("und"))
            columns = [batch.column("doc_id"), batch.column("held_out"), told, pa.array(np.minimum(score, 1.0)), pa.array(words)]
            if spans:
                which = p.argmax(axis=1) if len(p) else np.empty(0, np.int64)
                new = np.flatnonzero((np.diff(which, prepend=-1) != 0) | (np.diff(row, prepend=-1) > 0))
                runs = pa.StructArray.from_arrays([names.take(pa.array(which[new])), pa.array(np.diff(new, append=len(which)), pa.int32())], names=["lang", "words"])
                columns.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(row[new], np.arange(batch.num_rows + 1)), pa.int32()), runs))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "lang_pred", "score", "n_words"] + ["spans"] * spans)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_batches(out, run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, n_words long{more}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return label(docs, train(sample(docs)))
