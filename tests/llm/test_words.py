"""Phrase mining, lexical search and language labels: against brute force, with nulls, ties, repeats and empty tables."""

import itertools
import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from tessarix.llm import crf, lexical, phrases, sql
from tessarix.llm.common import table
from tessarix.llm.words import PHRASE, TERM, cut_words

SF = "/root/testdata/sf0.001"
LOW = {c: c + 32 for c in range(65, 91)}
DOCS = "doc_id long, text string, lang string, source string, n int, rank int, score string, m string, size int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, None, 1, 2, "x", "y", 3) for i, t, lang in rows], DOCS)


def slow_phrases(rows):
    """(lang, rank, phrase, a, l, r, n, score), by counting everything."""
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, 5):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if a >= 30 and len(p) > 1}
        found = []
        for p, a in often.items():
            score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            inside = any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * b >= 80 * a for q, b in often.items())
            if not inside:
                found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:2000], 1)]
    return sorted(out)


ROWS = [(i, "New York is big. new york, New York City Hall; the of the\nof the of Ünd Ünd", ("en", "de", None)[i % 3]) for i in range(100)]
ROWS += [(1, None, "en"), (None, "", None), (7, "  \t\n", "fr"), (8, "a b " * 20_000, "fr"), (8, "x y z w v. " * 35, "fr")]


def test_phrases(spark):
    names = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    docs = frame(spark, ROWS)
    assert sorted(tuple(r[c] for c in names) for r in phrases.collocations(docs).collect()) == slow_phrases(ROWS)
    assert phrases.collocations(docs.limit(0)).count() == 0
    assert phrases.collocations(frame(spark, ROWS[:20])).count() == 0  # nothing is frequent
    some = phrases.collocations(docs, most=1).collect()
    assert sorted((r.lang, r.phrase) for r in some) == sorted((x[0], x[2]) for x in slow_phrases(ROWS) if x[1] == 1)


def test_trie_bursts_and_leaves(monkeypatch):
    monkeypatch.setattr(phrases, "CONTAINER", 50)
    rng = np.random.default_rng(4)
    trie, want, gone = phrases.HatTrie(container=50), Counter(), Counter()
    for turn in range(60):
        heads, tails = rng.zipf(1.4, 400) % 60, rng.integers(0, 500, 400)
        heads[:100] = 3  # one head alone overflows containers
        keys = (heads.astype(np.uint64) << np.uint64(32)) | tails.astype(np.uint64)
        trie.add(keys)
        want.update(keys.tolist())
        if turn % 20 == 19:
            keys, counts = trie.leave(200)
            assert (np.diff(keys.astype(object)) > 0).all() and len(trie) <= 200
            gone.update(dict(zip(keys.tolist(), counts.tolist())))
    assert len(trie.leaves) > 60 and (np.diff(trie.begins.astype(object)) > 0).all()
    keys, counts = trie.leave(0)
    gone.update(dict(zip(keys.tolist(), counts.tolist())))
    assert gone == want


def merged(counter_parts, blocks):
    rows = pa.Table.from_batches(blocks).to_pandas().sort_values(["part", "lang", "size", "first"], kind="stable")
    out = Counter()
    for part in range(counter_parts):
        mine = rows[rows.part == part]
        for batch in phrases._merged([pa.RecordBatch.from_pandas(mine.iloc[i : i + 3], preserve_index=False) for i in range(0, len(mine), 3)]):
            for r in batch.to_pylist():
                if r["size"] != 1:
                    key = (r["lang"], r["size"], r["h1"], r["h2"], r["h3"], r["h4"])
                    assert not r["size"] or key not in out
                    out[key] += r["f"]
    return out


def test_runs_of_a_task(monkeypatch):
    """However often subtrees leave and blocks are added up, the counts are the same."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.3, 300) % 90) for _ in range(60)]

    def whole(bitmap):
        counter, out = phrases._Counter(4, bitmap), []
        for i in range(0, 60, 5):
            counter.take(["en"] * 5, pa.array(texts[i : i + 5]))
            out += counter.runs(False)
        return merged(4, [*out, *counter.runs(True)]), len(out)

    every = np.full(1 << 13, 255, np.uint8)
    want = [whole(None), whole(every)]
    assert want[0][1] == 0
    for name, value in (("TASK_KEYS", 900), ("CONTAINER", 64), ("BLOCK", 16), ("MERGE_ROWS", 40)):
        monkeypatch.setattr(phrases, name, value)
    got = [whole(None), whole(every)]
    assert got[0][1] > 0 and [x[0] for x in got] == [x[0] for x in want]
    words = Counter(p for t in texts for p in zip(*[t.split()[k:] for k in range(2)]))
    assert sorted(words.values(), reverse=True)[:9] == sorted((n for k, n in got[0][0].items() if k[1] == 2), reverse=True)[:9]
    monkeypatch.setattr(phrases, "TASK_WORDS", 20)  # ids begin anew
    assert [whole(None)[0], whole(every)[0]] == [x[0] for x in want]


def test_shared_hash_of_a_frequent_word_stops(monkeypatch):
    monkeypatch.setattr(phrases, "word_hash", lambda w: len(w))
    counter = phrases._Counter(1, None)
    counter.take(["en"], pa.array(["aa " * 40 + "b ccc ddd"]))
    blocks = pa.Table.from_batches([*counter.runs(True)]).to_batches()
    got = merged(1, blocks)  # ccc and ddd share one, but neither is frequent
    assert got["en", 0, None, None, None, None] == 43
    counter.take(["en"], pa.array(["aa " * 40 + "bb"]))
    with pytest.raises(ValueError, match="shares"):
        merged(1, [*counter.runs(True)])


def slow_search(docs, items, most=20):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    held = [(i, terms(t)) for i, t in docs]
    held = [(i, t) for i, t in held if t]
    n_docs, n_terms = len(held), sum(len(t) for _, t in held)
    df = Counter(x for _, t in held for x in set(t))
    asked = defaultdict(Counter)
    for i, t in dict.fromkeys(items):
        asked[i].update(terms(t))
    out = []
    for item, q in asked.items():
        found = []
        for i, t in held:
            m, tf = 75 + 25 * len(t) * n_docs // n_terms, Counter(t)
            score = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (10**9 * tf[x] // (1000 * tf[x] + 12 * m)) for x, k in q.items() if tf[x])
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(found)[:most], 1)]
    return sorted(out, key=str)


def test_search(spark):
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(f"w{x}" for x in rng.zipf(1.5, rng.integers(1, 200)) % 300)) for i in range(150)]
    rows += [(500 + i, "copy of one long text, Ünï 12") for i in range(60)] + [(3, rows[3][1]), (None, rows[4][1]), (900, None), (901, ""), (902, "-- !"), (903, "w1 " * 30_000)]
    docs = frame(spark, [(i, t, "en") for i, t in rows])
    items = [(1, "w1 w2 w2 W3"), (1, "w1 w2 w2 W3"), (2, "copy ünï of"), (2, "Text ÜNï"), (3, None), (4, "nowhere"), (5, ""), (6, " ".join(f"w{i}" for i in range(90))), (7, "12 one")]
    asked = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, score int")
    names = ["item_id", "rank", "doc_id", "score"]
    want = slow_search(rows, items)
    assert sorted((tuple(r[c] for c in names) for r in lexical.search(docs, asked).collect()), key=str) == want
    assert sorted((tuple(r[c] for c in names) for r in lexical.search(docs, asked, most=3).collect()), key=str) == [x for x in want if x[1] <= 3]
    assert lexical.search(docs.limit(0), asked).count() == 0 and lexical.search(docs, asked.limit(0)).count() == 0


def test_search_in_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(lexical, "ITEM_TERMS", 40)  # on the driver alone
    docs, items = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    assert len(list(lexical.item_blocks(items))) > 3
    got = sorted(tuple(r) for r in lexical.search(docs, items).collect())
    assert got == sorted(slow_search([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()]))


def test_search_without_exact_doubles():
    asked = lexical.Asked([type("R", (), dict(item_id=1, term=t, q=q)) for t, q in (("a", 10**9), ("b", 1))])
    asked.weigh(np.array([1, 2]), 10)
    assert not asked.exact
    row = lexical._table(lexical._NARROW, [(80, 10**18, [4, 9], *[lexical._pack(np.array(x)) for x in ([0, 1], [2, 1], [3, 1, 1], [0, 1, 1])])])
    got = [r for b in lexical._scored(asked, 20)([row]) for r in b.to_pylist()]
    w = asked.weights.tolist()
    one = lambda tf: 10**9 * tf // (1000 * tf + 12 * 80)
    assert [(r["doc_id"], r["score"]) for r in got] == [(4, w[0] * one(3)), (9, w[0] * one(1) + w[1] * one(1))]


def slow_marginals(scores, start, steps):
    out, edges = [], [*np.flatnonzero(start), len(scores)]
    for a, b in itertools.pairwise(edges):
        p = np.zeros((b - a, scores.shape[1]))
        for path in itertools.product(range(scores.shape[1]), repeat=b - a):
            weight = math.exp(sum(scores[a + i, y] for i, y in enumerate(path)) + sum(steps[x, y] for x, y in itertools.pairwise(path)))
            for i, y in enumerate(path):
                p[i, y] += weight
        out.append(p / p.sum(axis=1, keepdims=True))
    return np.concatenate(out)


def test_marginals():
    rng = np.random.default_rng(8)
    for k, lengths in ((3, [1, 6, 2, 1, 5, 7]), (2, [11, 1, 1]), (1, [4]), (4, [5])):
        start = np.concatenate([[True] + [False] * (n - 1) for n in lengths])
        scores, steps = rng.normal(0, 2, (len(start), k)), rng.normal(0, 1, (k, k))
        assert np.allclose(crf.marginals(scores, start, steps), slow_marginals(scores, start, steps))


LANGUAGES = {"en": "the house and water is where people often think about things", "de": "das haus und wasser ist wo menschen oft über dinge nachdenken", "fr": "la maison et l'eau où les gens pensent souvent aux choses"}


def test_labels(spark):
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(rng.permutation(LANGUAGES[lang].split())), lang) for i in range(120) for lang in [list(LANGUAGES)[i % 3]]]
    rows += [(900, None, "en"), (901, "", "de"), (902, "12 — 34 !?", "fr"), (None, LANGUAGES["de"], None), (903, "the house and water is where das haus und wasser ist wo menschen", None), (904, LANGUAGES["en"] + " ", "xx"), (904, LANGUAGES["en"] + " ", "xx"), (905, "water " * 40_000, None)]
    docs = frame(spark, rows)
    model = crf.train(crf.sample(docs.where("lang <> 'xx'")))
    got = crf.label(docs, model, spans=True).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[i].lang_pred == lang for i, _, lang in rows[:120])
    assert all((by_id[i].lang_pred, by_id[i].score) == ("und", 0.0) for i in (900, 901, 902))
    assert by_id[None].lang_pred == "de" and not by_id[None].held_out
    assert [s.lang for s in by_id[903].spans] == ["en", "de"] and abs(by_id[903].spans[0].words - 6) <= 1
    assert by_id[905].n_words == 40_000 and by_id[905].lang_pred == "en"
    assert {r.held_out for r in got} == {True, False} and all(0 <= r.score <= 1 for r in got)
    assert crf.label(docs.limit(0), model).count() == 0
    assert {r.lang_pred for r in crf.label(docs, crf.train(crf.sample(docs.where("lang is null")))).collect()} == {"und"}
    only = crf.train(crf.sample(docs.where("lang = 'de'")))
    assert {r.lang_pred for r in crf.label(docs, only).collect()} == {"de", "und"}


def test_labels_of_held_out_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = crf.query(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang_pred <> 'und'").toPandas()
    assert len(got) > 150 and (got.lang == got.lang_pred).mean() > 0.97


def test_words_of_a_batch():
    texts = ["Ab ab, c", None, "", "é1 x", "  ", "end"]
    for kind, pattern in ((TERM, r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), (PHRASE, r"[^\x20\x09.,;:!?\x0A-\x0D]+")):
        found = cut_words(pa.array(texts), kind)
        got = list(zip(found.row.tolist(), [found.known[c].as_py() for c in found.code]))
        assert got == [(i, w) for i, t in enumerate(texts) for w in re.findall(pattern, (t or "").translate(LOW))]
    assert not len(cut_words(pa.array([], pa.string()), TERM).code)


def test_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(sql.ORACLES["op13_ranked_search"]).df()
    got = lexical.query(spark, SF).toPandas()
    assert sorted(map(tuple, got[["item_id", "rank", "doc_id", "score"]].values.tolist())) == sorted(map(tuple, want[["item_id", "rank", "doc_id", "score"]].values.tolist()))
    assert isinstance(got, pd.DataFrame) and len(got)
