"""Phrases of two to four words that stand together far more often than their parts, counted by HAT-tries.

Every task counts its words and word pairs in tries of word ids. The upper levels are trie nodes, everything below lies
in hash containers; a container that overflows bursts: one that several first words share splits between two of them,
one that a single word owns becomes a node whose containers part by the next word. When a task holds too much, its
largest subtrees leave as runs sorted by path. Runs are dealt to prefix partitions, where Spark sorts their blocks by
first word and a merge adds up equal paths while it reads them, so no partition is ever held whole. Partitions follow from the first two words;
longer phrases are dealt by their whole path, as one frequent pair may begin a third of them.

Longer phrases are counted in a second pass, only where all pairs inside are frequent. A bitmap with one bit for each
hash of a frequent pair tells; it has a fixed largest size, and where it errs it lets pairs through, never drops one, so results are exact.
Paths are 64-bit hashes of words. A frequent word that shares its hash with any other word stops the job, so equal
hashes are equal words wherever a phrase can be frequent.

Defined results: a null text has no words, a null lang counts as ``und``; repeated rows count each; doc_id isn't read; an empty table
gives no row; a candidate's ties go to the smallest cut, those of a rank to the phrase that is first by bytes; further columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, few, in_batches, slices, table
from .words import BREAK, PHRASE, cut_words

#: A phrase has so many words at most, and stands so often at least.
LONGEST, LEAST = 4, 30
#: Places of a language's list.
MOST = 2000
#: Keys that a container holds before it bursts, and that a task's tries hold before subtrees leave (some 30 bytes each).
CONTAINER, TASK_KEYS = 1 << 16, 3 << 20
#: Distinct words and pairs that a task gives ids to before it begins anew.
TASK_WORDS = 1 << 20
#: Entries of a block of a run, and of blocks that a merge holds before it adds up.
BLOCK, MERGE_ROWS = 4096, 1 << 20
#: Bits of the bitmap for each frequent pair, and in all at most (32 MiB).
BITS_EACH, MOST_BITS = 16, 1 << 28
#: A lang's candidates are ranked in so many parts first.
PARTS = 64

_HALF = np.uint64(32)
_LOW = np.uint64(0xFFFFFFFF)
_PAIR = np.uint64(1 << 31)
_RUN = "lang string, part int, size int, first long, paths binary, counts binary, words binary"
_GRAM = "lang string, size int, h1 long, h2 long, h3 long, h4 long, word string, f long"


def word_hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little", signed=True)


class Container:
    """A hash container: counts by key, in arrays; what is added waits until it is worth a pass."""

    __slots__ = ("keys", "counts", "folded", "waiting")

    def __init__(self, keys=(), counts=()):
        self.keys, self.counts = [np.asarray(keys, np.uint64)], [np.asarray(counts, np.int64)]
        self.folded, self.waiting = len(keys), 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.waiting += len(keys)
        if self.waiting > max(self.folded, CONTAINER // 8):
            self.fold()

    def fold(self) -> None:
        codes, keys = pd.factorize(np.concatenate(self.keys))
        sums = np.zeros(len(keys), np.int64)
        np.add.at(sums, codes, np.concatenate(self.counts))
        self.keys, self.counts, self.folded, self.waiting = [keys], [sums], len(keys), 0

    def __len__(self) -> int:
        return self.folded + self.waiting

    def sorted(self) -> tuple[np.ndarray, np.ndarray]:
        self.fold()
        order = np.argsort(self.keys[0])
        return self.keys[0][order], self.counts[0][order]


class HatTrie:
    """Counts of paths (head id, tail id), both below 2**32; containers stand in the order of the paths that they begin with."""

    def __init__(self, container: int = CONTAINER):
        self.most, self.begins, self.leaves = container, np.zeros(1, np.uint64), [Container()]

    def __len__(self) -> int:
        return sum(map(len, self.leaves))

    def add(self, keys: np.ndarray) -> None:
        """Count each of ``keys`` (head << 32 | tail) once."""
        keys, counts = np.unique(keys, return_counts=True)
        cuts = [0, *np.searchsorted(keys, self.begins[1:]).tolist(), len(keys)]
        full = []
        for i, leaf in enumerate(self.leaves):
            if cuts[i + 1] > cuts[i]:
                leaf.add(keys[cuts[i] : cuts[i + 1]], counts[cuts[i] : cuts[i + 1]])
                if leaf.folded > self.most:
                    full.append(i)
        for i in reversed(full):
            self.burst(i)

    def burst(self, i: int) -> None:
        keys, counts = self.leaves[i].sorted()
        heads, middle = keys >> _HALF, len(keys) // 2
        at = middle  # a container of one head alone: a node below it, whose containers part by tail
        if heads[0] != heads[-1]:
            low, high = np.searchsorted(heads, heads[middle]), np.searchsorted(heads, heads[middle], side="right")
            at = int(low if low and (middle - low <= high - middle or high == len(keys)) else high)
        self.leaves[i : i + 1] = [Container(keys[:at], counts[:at]), Container(keys[at:], counts[at:])]
        self.begins = np.insert(self.begins, i + 1, keys[at])

    def leave(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Take out whole subtrees, the largest first, until ``most`` keys stay: their paths in order, with counts."""
        heads = self.begins >> _HALF
        trees = np.concatenate(([0], np.cumsum(heads[1:] != heads[:-1])))  # containers of one burst head go together
        sizes = np.bincount(trees, weights=[len(x) for x in self.leaves])
        held, gone = int(sizes.sum()), set()
        for tree in np.argsort(-sizes, kind="stable").tolist():
            if held <= most:
                break
            held -= int(sizes[tree])
            gone.add(tree)
        taken = []
        for i, tree in enumerate(trees.tolist()):
            if tree in gone:
                taken.append(self.leaves[i].sorted())
                self.leaves[i] = Container()
        if not taken:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        return np.concatenate([k for k, _ in taken]), np.concatenate([c for _, c in taken])


def _spread(columns: list[np.ndarray], lang: str) -> np.ndarray:
    """A hash of paths and language for partitions and bitmap."""
    out = np.full(len(columns[0]), np.uint64(word_hash(lang) & (2**64 - 1)))
    for c in columns:
        out = (out ^ c.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


class _Ids:
    """Ids of what a task meets, from 0 on."""

    def __init__(self):
        self.of: dict = {}

    def __len__(self):
        return len(self.of)

    def give(self, items: list) -> np.ndarray:
        of = self.of
        return np.fromiter((of.setdefault(x, len(of)) for x in items), np.int64, len(items)).astype(np.uint64)


class _Counter:
    """What one task counts: singles and pairs, or longer phrases of pairs that ``bitmap`` lets through."""

    def __init__(self, parts: int, bitmap: np.ndarray | None):
        self.parts, self.bitmap = parts, bitmap
        self.squeeze = zstandard.ZstdCompressor(level=1)
        self.begin()

    def begin(self) -> None:
        self.words, self.hashes, self.pairs = _Ids(), np.empty(0, np.int64), _Ids()
        self.tries: dict[str, HatTrie] = {}
        self.singles: dict[str, np.ndarray] = {}

    def take(self, langs: list[str], texts: pa.Array) -> None:
        found = cut_words(texts, PHRASE)
        if not len(found.code):
            return
        ids = self.words.give(found.known.to_pylist())
        if len(self.words) > len(self.hashes):
            new = islice(self.words.of, len(self.hashes), None)
            self.hashes = np.concatenate((self.hashes, np.fromiter(map(word_hash, new), np.int64, len(self.words) - len(self.hashes))))
        ids = ids[found.code]
        breaks = np.flatnonzero(BREAK[found.data])
        piece = np.searchsorted(breaks, found.begin) + found.row * (len(breaks) + 1)
        names, of = np.unique(np.array(langs, dtype=object), return_inverse=True)
        of = of[found.row]
        for k, lang in enumerate(names.tolist()):
            mine = of == k
            if mine.any():
                self.count(lang, ids[mine], piece[mine])

    def count(self, lang: str, ids: np.ndarray, piece: np.ndarray) -> None:
        trie = self.tries.setdefault(lang, HatTrie())
        together = piece[1:] == piece[:-1]
        pairs = (ids[:-1] << _HALF) | ids[1:]
        if self.bitmap is None:
            seen = np.bincount(ids.astype(np.int64), minlength=len(self.words))
            had = self.singles.get(lang, np.empty(0, np.int64))
            seen[: len(had)] += had
            self.singles[lang] = seen
            trie.add(pairs[together])
            return
        place = _spread([self.hashes[ids[:-1].astype(np.int64)], self.hashes[ids[1:].astype(np.int64)]], lang) & np.uint64(len(self.bitmap) * 8 - 1)
        good = together & ((self.bitmap[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
        codes, distinct = pd.factorize(pairs[good])
        own = np.zeros(len(pairs), np.uint64)
        own[good] = self.pairs.give(distinct.tolist())[codes]
        three = np.flatnonzero(good[:-1] & good[1:])
        four = np.flatnonzero(good[:-2] & good[1:-1] & good[2:])
        trie.add(np.concatenate(((own[three] << _HALF) | ids[three + 2], (own[four] << _HALF) | _PAIR | own[four + 2])))

    def runs(self, all_of_them: bool) -> Iterator[pa.RecordBatch]:
        """What leaves: when the task ends or has given enough ids, everything; else subtrees once there are too many keys."""
        anew = all_of_them or len(self.words) > TASK_WORDS or len(self.pairs) > TASK_WORDS
        held = sum(map(len, self.tries.values()))
        if not anew and held <= TASK_KEYS:
            return
        kept = 0 if anew else TASK_KEYS // 2
        texts = np.array(list(self.words.of), dtype=object) if anew else None
        whole = np.fromiter(self.pairs.of, np.uint64, len(self.pairs))
        of = lambda ids: self.hashes[ids.astype(np.int64)]
        for lang, trie in self.tries.items():
            keys, counts = trie.leave(len(trie) * kept // max(1, held))
            heads, tails = keys >> _HALF, keys & _LOW
            if self.bitmap is None:
                yield from self.blocks(lang, [of(heads), of(tails)], counts)
            else:
                heads, double = whole[heads.astype(np.int64)], (tails & _PAIR) > 0
                first, second = of(heads >> _HALF), of(heads & _LOW)
                yield from self.blocks(lang, [first[~double], second[~double], of(tails[~double])], counts[~double])
                last = whole[(tails[double] & ~_PAIR).astype(np.int64)]
                yield from self.blocks(lang, [first[double], second[double], of(last >> _HALF), of(last & _LOW)], counts[double])
        if anew:
            for lang, seen in self.singles.items():
                at = np.flatnonzero(seen)
                yield from self.blocks(lang, [self.hashes[at]], seen[at], texts[at])
            self.begin()

    def blocks(self, lang: str, path: list[np.ndarray], counts: np.ndarray, words: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        """A run for each prefix partition, sorted by path, in blocks."""
        part = (_spread(path, lang) % np.uint64(self.parts)).astype(np.int32)
        order = np.lexsort((path[0], part))
        part, counts, path = part[order], counts[order], [c[order] for c in path]
        edges = np.flatnonzero(np.diff(part, prepend=-1, append=-1)).tolist()
        rows = []
        pack = lambda a: self.squeeze.compress(np.ascontiguousarray(a).tobytes())
        for low, high in zip(edges, edges[1:]):
            for i in range(low, high, BLOCK):
                j = min(i + BLOCK, high)
                text = None if words is None else self.squeeze.compress("\n".join(words[order[i:j]]).encode())
                rows.append((lang, int(part[low]), len(path), int(path[0][i]), pack(np.stack([c[i:j] for c in path])), pack(counts[i:j]), text))
        if rows:
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[c.split()[0] for c in _RUN.split(", ")])


def counted(docs: DataFrame, bitmap: np.ndarray | None = None) -> DataFrame:
    """Counts of words and pairs, or with a bitmap of frequent pairs those of longer phrases: _GRAM, the frequent ones and totals (size 0)."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = None if bitmap is None else spark.sparkContext.broadcast(bitmap)  # at most MOST_BITS

    def count(batches):
        counter = _Counter(parts, None if sent is None else sent.value)
        for batch in slices(batches, "text"):
            counter.take(batch.column("lang").to_pylist(), batch.column("text"))
            yield from counter.runs(False)
        yield from counter.runs(True)

    runs = in_batches(docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text"), count, _RUN)
    return in_batches(runs.repartition(parts, "part").sortWithinPartitions("lang", "size", "first"), _merged, _GRAM)


def _added(path: np.ndarray, counts: np.ndarray, words: np.ndarray | None):
    """Equal paths added up, in order; with words, those of equal hash and word."""
    order = np.lexsort(path[::-1])
    path, counts = path[:, order], counts[order]
    new = np.concatenate(([True], (path[:, 1:] != path[:, :-1]).any(axis=0)))
    if words is not None:
        words = words[order]
        if (words != words[np.flatnonzero(new)][np.cumsum(new) - 1]).any():  # two words of one hash: put each word's counts together
            order = np.array(sorted(range(len(words)), key=lambda i: (path[0, i], words[i])))
            path, counts, words = path[:, order], counts[order], words[order]
            new = np.concatenate(([True], (path[0, 1:] != path[0, :-1]) | (words[1:] != words[:-1])))
    at = np.flatnonzero(new)
    return path[:, at], np.add.reduceat(counts, at), None if words is None else words[at]


def _merged(batches) -> Iterator[pa.RecordBatch]:
    """Blocks come by language, size and first word: paths that begin below the next block's first are complete."""
    open_zstd = zstandard.ZstdDecompressor()
    key, waiting, held = None, [], 0

    def close(first: int | None):
        nonlocal waiting, held
        if not waiting:
            return
        lang, size = key
        path, counts, words = _added(np.concatenate([w[0] for w in waiting], axis=1), np.concatenate([w[1] for w in waiting]), np.concatenate([w[2] for w in waiting]) if size == 1 else None)
        done = path.shape[1] if first is None else int(np.searchsorted(path[0], first))
        waiting = [(path[:, done:], counts[done:], None if words is None else words[done:])] if done < path.shape[1] else []
        held = path.shape[1] - done
        if size == 1 and done:  # all words of the language, frequent or not
            yield _grams(lang, 0, np.empty((0, 1), np.int64), counts[:done].sum(keepdims=True), None)
        often = np.flatnonzero(counts[:done] >= LEAST)
        if size == 1 and len(often):
            twice = path[0, 1:done] == path[0, : done - 1]
            if (np.concatenate((twice, [False])) | np.concatenate(([False], twice)))[often].any():
                raise ValueError("a frequent word shares its 64-bit hash with another word: take another hash")
        if len(often):
            yield _grams(lang, size, path[:, often], counts[often], None if words is None else words[often])

    for batch in batches:
        for row in batch.to_pylist():
            if key != (row["lang"], row["size"]):
                yield from close(None)
                key = (row["lang"], row["size"])
            elif held > MERGE_ROWS:
                before = held
                yield from close(row["first"])
                held = min(held, before // 2)  # a frequent first word that fills many blocks is added up again only after as many more
            path = np.frombuffer(open_zstd.decompress(row["paths"]), np.int64).reshape(row["size"], -1)
            words = np.array(open_zstd.decompress(row["words"]).decode().split("\n"), dtype=object) if row["size"] == 1 else None
            waiting.append((path, np.frombuffer(open_zstd.decompress(row["counts"]), np.int64), words))
            held += path.shape[1]
    yield from close(None)


def _grams(lang: str, size: int, path: np.ndarray, counts: np.ndarray, words: np.ndarray | None) -> pa.RecordBatch:
    n = len(counts)
    columns = [pa.array([lang] * n, pa.string()), pa.array([size] * n, pa.int32())]
    columns += [pa.array(path[i], pa.int64()) if i < size else pa.nulls(n, pa.int64()) for i in range(LONGEST)]
    columns += [pa.nulls(n, pa.string()) if words is None else pa.array(words, pa.string()), pa.array(counts, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _GRAM.split(", ")])


def pair_bitmap(grams: DataFrame) -> np.ndarray:
    """A bit for the hash of each frequent pair; its words of 64 bits are made by Spark, at most MOST_BITS / 64 of them."""
    pairs = grams.where("size = 2").select("lang", "h1", "h2")
    bits = min(MOST_BITS, max(1 << 16, 1 << (BITS_EACH * pairs.count()).bit_length()))

    def places(batches):
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            h1, h2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2"))
            place = np.empty(len(langs), np.uint64)
            for lang in set(langs.tolist()):
                mine = langs == lang
                place[mine] = _spread([h1[mine], h2[mine]], lang) & np.uint64(bits - 1)
            yield pa.RecordBatch.from_arrays([pa.array((place >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (place & np.uint64(63))).view(np.int64))], names=["slot", "bit"])

    words = in_batches(pairs, places, "slot long, bit long").groupBy("slot").agg(F.bit_or("bit").alias("bit")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words.column("slot").to_numpy()] = words.column("bit").to_numpy()
    return out.view(np.uint8)


def _spelled(grams: DataFrame, words: DataFrame) -> DataFrame:
    """lang, words, phrase, a of all frequent phrases of two words and more; a path with a hash of no frequent word is none."""
    path = F.filter(F.array("h1", "h2", "h3", "h4"), lambda x: x.isNotNull())
    long = grams.where("size > 1").select("lang", path.alias("path"), F.col("f").alias("a"))
    each = long.select("lang", "path", "a", F.posexplode("path").alias("place", "hash"))
    named = each.join(few(words.select("lang", F.col("h1").alias("hash"), "word")), ["lang", "hash"])
    whole = named.groupBy("lang", "path", "a").agg(F.array_sort(F.collect_list(F.struct("place", "word"))).alias("w")).where(F.size("w") == F.size("path"))
    return whole.select("lang", "a", F.col("w.word").alias("words")).withColumn("phrase", F.array_join("words", " "))


def _part(start: Column | int, length: Column | int) -> Column:
    return F.array_join(F.slice("words", start, length), " ")


def collocations(docs: DataFrame, most: int = MOST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``most`` best phrases of each language."""
    first = cut(counted(docs), "words")
    grams = first
    if first.where("size = 2").limit(1).count():
        second = cut(counted(docs, pair_bitmap(first)), "longer")
        grams = first.unionByName(second)
    words = cut(grams.where("size = 1").select("lang", "h1", "word", "f"), "known")
    found = cut(_spelled(grams, words), "phrases")
    counts = cut(words.select("lang", F.col("word").alias("part"), "f").unionByName(found.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"))), "counts")
    known = few(counts)
    each = found.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    each = each.select("lang", "phrase", "a", "k", _part(F.lit(1), F.col("k")).alias("left"), _part(F.col("k") + 1, F.size("words") - F.col("k")).alias("right"))
    each = each.join(known.select("lang", F.col("part").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(known.select("lang", F.col("part").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    score = F.expr("(cast(a as decimal(20, 0)) * 2000000) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))")
    scored = each.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    # contiguous parts of two words and more, with the count of the most frequent phrase around them
    spans = F.filter(F.flatten(F.transform(F.sequence(F.lit(2), F.size("words") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.size("words") - m + 1), lambda i: _part(i, m)))), lambda x: x.isNotNull())
    around = found.where(F.size("words") > 2).select("lang", "a", F.explode(F.array_distinct(spans)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(around, ["lang", "phrase"], "left").where("longer is null or cast(longer as decimal(20, 0)) * 100 < cast(a as decimal(20, 0)) * 80")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = kept.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= most)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= most)
    totals = first.where("size = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
