"""Substring dedup by sliding sentence spans.

A text is cut after sentence ends and line ends, and sentences of 16 words and more also where their words say so: before
a pair of words whose hash is the least of the pairs near it. So a passage gets the same cuts inside wherever it stands.
In scripts without spaces each character is a word. A run of consecutive sentences with two sentences and 20 words at
least is hashed by its words; of those from one sentence on, and of those up to one, the shortest is enough, as the
sentences of any longer repeated run are covered by such runs inside it. Runs meet by hash over the whole corpus; the
first place of a run, by doc_id and then position, stays, and sentences covered by any other place of it go.

Runs are written once. Only hash and count are shuffled to find the repeated hashes; rows of these alone go on, first
places are aggregated map-side, so a span that a third of all documents share is one row a task there, and the joins
read tables, so Spark may split a frequent hash. The way is the same at every size; nothing is sent to all executors.

Defined results: a null text stays null, an empty one empty; a text without repeated runs comes back byte for byte;
rows that share a doc_id are told apart by their text, rows equal in both are one document and keep what it keeps; rows
with null doc_id come first in order; an empty table gives an empty result. All further columns are carried along
unchanged, but for a column n_removed, which is replaced. Two different runs get one hash with a chance of 2^-64.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, free, in_batches, joined, mixed, slices, table, unused, word_hashes

LEAST_SENTENCES, LEAST_WORDS, LONGEST = 2, 20, 16
#: A cut stands before the least of the pairs of words this far to either side.
NEAR = 3
#: Stops that need white space behind them, stops that don't, and what may close a sentence behind these.
_STOP, _WIDE, _CLOSE = ".!?…؟۔।॥።", "。！？｡", "」』）”’"
#: Up to a stop, a line end, or the end of the text; a stop inside a word ends nothing.
_SENTENCE = re.compile(rf"[^\n{_STOP}{_WIDE}]*(?:[{_STOP}]+(?!\s|[{_STOP}{_WIDE}])[^\n{_STOP}{_WIDE}]*)*(?:[{_STOP}]*[{_WIDE}][{_STOP}{_WIDE}{_CLOSE}]*\s*|[{_STOP}]+\s+|\n\s*|[{_STOP}]*$)")
#: Thai, Lao, Tibetan, Burmese, Khmer, kana and Han.
_UNSPACED = "฀-࿿က-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿ｦ-ﾟ\U00020000-\U0003ffff"
_WORD = re.compile(rf"(?:[{_UNSPACED}]|[^\s{_UNSPACED}]+)\s*")
#: Texts with none of these need ASCII alone to find words and sentences.
_SPECIAL = re.compile(rf"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000{_STOP[3:]}{_WIDE}{_UNSPACED}]")
_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?")] = True
_U = np.uint64
_FIRST, _SECOND, _COUNT = _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9), _U(0x27D4EB2F165667C5)
#: The odd base of the hashes of sentences and runs, and its inverse modulo 2^64.
_STEP = 0x9FB21C651E98DF25
_BACK = pow(_STEP, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[_U(1)], np.full(n, base, dtype=np.uint64)]))


def _plain_words(texts: pa.Array) -> tuple:
    """(text, begin in it, hash, starts a sentence) of each word, and whether an empty sentence leads each text."""
    data, starts = joined(texts)
    begin, end, hashes = word_hashes(data)
    doc = np.searchsorted(starts, begin, side="right") - 1
    lines = np.flatnonzero(data == 10)
    new = np.diff(doc, prepend=-1) != 0
    behind = np.concatenate([[0], end[:-1]])  # where the gap before each word begins
    behind[new] = starts[doc[new]]
    line = np.searchsorted(lines, begin) > np.searchsorted(lines, behind)
    lead = np.zeros(len(texts), bool)
    lead[doc[new & line]] = True
    stopped = np.concatenate([[False], _ENDS[data[end[:-1] - 1]]])
    return doc, begin - starts[doc], hashes, new | line | stopped, lead


def _other_words(texts: list[str]) -> tuple:
    """The same of texts with any characters."""
    doc, begin, words, first, lead = [], [], [], [], np.zeros(len(texts), bool)
    for d, text in enumerate(texts):
        at = 0
        for n, piece in enumerate(filter(None, _SENTENCE.findall(text))):
            here = at + len(piece[: len(piece) - len(piece.lstrip())].encode())
            found = _WORD.findall(piece)
            lead[d] |= not n and not found
            for k, w in enumerate(found):
                doc.append(d)
                begin.append(here)
                words.append(w.rstrip())
                first.append(not k)
                here += len(w.encode())
            at += len(piece.encode())
    hashes = word_hashes(np.frombuffer(" ".join(words).encode(), np.uint8))[2]
    return np.array(doc, np.int64), np.array(begin, np.int64), hashes, np.array(first, bool), lead


def _content_cuts(hashes: np.ndarray, sentence: np.ndarray, place: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether a cut stands before each word: its pair with the next is the least near it; ties are cut all."""
    worst = _U((1 << 64) - 1)
    mark = np.full(len(hashes), worst)
    mark[:-1] = mixed(hashes[:-1] * _FIRST + hashes[1:] * _SECOND) >> _U(1)
    mark[(place == 0) | (place == length - 1)] = worst
    least = mark.copy()
    for k in range(1, NEAR + 1):
        same = sentence[k:] == sentence[:-k]
        np.minimum(least[k:], np.where(same, mark[:-k], worst), out=least[k:])
        np.minimum(least[:-k], np.where(same, mark[k:], worst), out=least[:-k])
    return (mark == least) & (mark < worst)


def segmented(texts: pa.Array, plain: bool = True) -> tuple:
    """(text, number in it, begin in its bytes, words, hash) of each sentence; a sentence ends where the next begins."""
    known = texts.to_pylist() if len(texts) else []
    special = np.array([not plain or t is not None and bool(_SPECIAL.search(t)) for t in known], bool)
    which = [np.flatnonzero(~special), np.flatnonzero(special)]
    parts = [_plain_words(texts.filter(pa.array(~special))) if len(known) else None, _other_words([known[i] or "" for i in which[1]]) if special.any() else None]
    lead = np.zeros(len(known), bool)
    for w, p in zip(which, parts, strict=True):
        if p:
            lead[w] = p[4]
    doc, begin, hashes, first = (np.concatenate([w[p[0]] if not k else p[k] for w, p in zip(which, parts, strict=True) if p] or [np.empty(0, np.int64)]) for k in range(4))
    if not len(doc):
        return doc, doc, begin, doc, hashes
    at = np.flatnonzero(first)
    sentence = np.cumsum(first) - 1
    length = np.diff(np.append(at, len(first)))[sentence]
    long = np.flatnonzero(length >= LONGEST)
    if len(long):
        first = first.astype(bool)
        first[long] |= _content_cuts(hashes[long], sentence[long], (long - at[sentence[long]]), length[long])
        at = np.flatnonzero(first)
    words = np.diff(np.append(at, len(doc)))
    step = _powers(_STEP, int(words.max()))
    marks = mixed(np.add.reduceat(hashes * step[np.arange(len(doc)) - np.repeat(at, words)], at) + words.astype(np.uint64) * _COUNT)
    doc, begin = doc[at], begin[at]
    new = np.flatnonzero(np.diff(doc, prepend=-1))
    number = np.arange(len(doc)) - np.repeat(new, np.diff(np.append(new, len(doc)))) + lead[doc]
    begin[number == 0] = 0
    return doc, number, begin, words, marks


def sentences(text: str) -> list[str]:
    """The sentences of one text with the white space behind them: joined they are the text."""
    _, number, begin, _, _ = segmented(pa.array([text]))
    raw, begins = text.encode(), begin.tolist() or [0]
    if begins[0]:
        begins = [0, *begins]
    return [raw[a:b].decode() for a, b in zip(begins, [*begins[1:], len(raw)], strict=True) if b > a]


def runs(doc: np.ndarray, words: np.ndarray, least_sentences: int = LEAST_SENTENCES, least_words: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """First and behind-last index of the shortest runs from each sentence on and up to each sentence of its text."""
    n = len(doc)
    if not n:
        return doc, doc
    held = np.concatenate([[0], np.cumsum(words)])
    new = np.flatnonzero(np.diff(doc, prepend=-1))
    begin = np.repeat(new, np.diff(np.append(new, n)))
    end = np.repeat(np.append(new[1:], n), np.diff(np.append(new, n)))
    i = np.arange(n)
    j = np.maximum(np.searchsorted(held, held[:-1] + least_words), i + least_sentences)
    fits = j <= end
    behind = i + 1
    start = np.minimum(np.searchsorted(held, held[1:] - least_words, side="right") - 1, behind - least_sentences)
    also = start >= begin
    pairs = np.unique(np.concatenate([i[fits] * (n + 1) + j[fits], start[also] * (n + 1) + behind[also]]))
    return pairs // (n + 1), pairs % (n + 1)


def spans(docs: DataFrame, least_sentences: int = LEAST_SENTENCES, least_words: int = LEAST_WORDS) -> DataFrame:
    """hash, doc_id, row, first, behind, more of the runs; row tells rows with one doc_id apart.

    A document gives a hash one row, however often it repeats the run: its first place, and all further ones in ``more``
    (first and behind in turn). Only the first place can be the one that stays.
    """

    def run(batches):
        for batch in slices(batches, "text", 1 << 20):
            doc, number, _, words, marks = segmented(batch.column("text"))
            i, j = runs(doc, words, least_sentences, least_words)
            total = np.concatenate([[_U(0)], np.cumsum(marks * _powers(_STEP, len(marks))[:-1])]) if len(marks) else np.zeros(1, _U)
            span = mixed((total[j] - total[i]) * _powers(_BACK, len(marks))[i] + (j - i).astype(np.uint64)).view(np.int64)
            of, first = doc[i], number[i]
            order = np.lexsort((span, of))
            of, span, first, behind = of[order], span[order], first[order], (first + j - i)[order]
            again = np.zeros(len(of), bool)
            again[1:] = (of[1:] == of[:-1]) & (span[1:] == span[:-1])
            heads = np.flatnonzero(~again)
            further = np.diff(np.append(heads, len(of))) - 1
            more = np.stack([first[again], behind[again]], axis=1).ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], 2 * np.cumsum(further)]), pa.int32()), pa.array(more, pa.int32()))
            of = pa.array(of[heads])
            yield pa.RecordBatch.from_arrays([pa.array(span[heads]), batch.column("doc_id").take(of), batch.column("row").take(of), pa.array(first[heads], pa.int32()), pa.array(behind[heads], pa.int32()), lists], names=["hash", "doc_id", "row", "first", "behind", "more"])

    docs = docs.select(F.col("doc_id").cast("long"), F.col("row").cast("long"), "text")
    return in_batches(docs, run, "hash long, doc_id long, row long, first int, behind int, more array<int>")


def without(text: bytes, begins: np.ndarray, lost: np.ndarray, leads: bool) -> bytes:
    """``text`` without the lost sentences; ``leads``: an empty one, without a begin, stands before the others."""
    if leads:
        begins, lost = np.concatenate([[0], begins]), np.concatenate([lost[:1] & False, lost])
    ends = np.append(begins[1:], len(text))
    return b"".join([text[a:b] for a, b in zip(begins[~lost].tolist(), ends[~lost].tolist(), strict=True)])


def shortened(docs: DataFrame, ranges: str, out: str) -> DataFrame:
    """``docs`` without the sentences in ``ranges`` (first and behind in turn) and that column; ``out``: how many went."""
    names = [c for c in docs.columns if c != ranges]

    def run(batches):
        for batch in slices(batches, "text", 1 << 20):
            texts = batch.column("text")
            touched = np.flatnonzero(pc.fill_null(pc.greater(pc.list_value_length(batch.column(ranges)), 0), False).to_numpy(zero_copy_only=False))
            known, removed = texts.to_pylist(), np.zeros(len(texts), np.int64)
            doc, number, begin, _, _ = segmented(texts.take(pa.array(touched)))
            order = np.argsort(doc, kind="stable")
            number, begin = number[order], begin[order]
            bounds = np.searchsorted(doc[order], np.arange(len(touched) + 1))
            for k, d in enumerate(touched.tolist()):
                own = slice(bounds[k], bounds[k + 1])
                places = np.array(batch.column(ranges)[d].as_py())
                numbers, begins = number[own], begin[own]
                drop = np.zeros(int(numbers[-1]) + 2, dtype=np.int64)
                np.add.at(drop, places[::2], 1)
                np.add.at(drop, places[1::2], -1)
                lost = np.cumsum(drop)[numbers] > 0
                known[d] = without(known[d].encode(), begins, lost, bool(numbers[0])).decode()
                removed[d] = lost.sum()
            columns = [pa.array(known, pa.string()) if n == "text" else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(removed, pa.int32())], names=[*names, out])

    ddl = ", ".join(f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in names)
    return in_batches(docs, run, f"{ddl}, `{out}` int")


def dedup(docs: DataFrame, least_sentences: int = LEAST_SENTENCES, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with repeated runs removed from text, and n_removed, the sentences that went.

    With ``least_words`` 0 every run of ``least_sentences`` counts, however short; the default leaves runs of a few short
    sentences alone, which many documents share without being copies.
    """
    docs = docs.drop("n_removed")
    row, name, mark, ranges = unused(docs, "row", "name", "mark", "ranges")
    named = docs.withColumn(row, F.xxhash64("text"))
    every = cut(spans(named.select("doc_id", F.col(row).alias("row"), "text"), least_sentences, least_words), "runs")
    repeated = cut(every.groupBy("hash").agg(F.count("*").alias("n"), F.max(F.size("more")).alias("m")).where("n > 1 or m > 0").select(F.col("hash").alias("h")), "repeated")
    hits = cut(every.join(repeated, F.col("hash") == F.col("h")).drop("h"), "hits")
    free(every, repeated)
    place = F.struct("doc_id", "row")
    firsts = cut(hits.groupBy("hash").agg(F.min(place).alias("keep")).select(F.col("hash").alias("h"), "keep"), "firsts")
    later = hits.join(firsts, F.col("hash") == F.col("h"))
    later = later.withColumn("gone", F.when(place.eqNullSafe(F.col("keep")), F.col("more")).otherwise(F.concat(F.array("first", "behind"), "more"))).where(F.size("gone") > 0)
    gone = cut(later.groupBy("doc_id", "row").agg(F.flatten(F.collect_list("gone")).alias(ranges)).select(F.col("doc_id").alias(name), F.col("row").alias(mark), ranges), "gone")
    free(hits, firsts)
    same = F.col("doc_id").eqNullSafe(F.col(name)) & (F.col(row) == F.col(mark))
    # texts are dealt by document at every size, once
    return shortened(named.join(gone, same, "left").drop(row, name, mark), ranges, "n_removed")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
