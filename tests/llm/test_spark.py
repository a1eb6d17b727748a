"""The operators on small tables with nulls, empty and repeated rows, ties and clashing names, against brute force."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from test_local import pairs_of, slow_sentences
from tessarix.llm import bpe, bytebpe, hilbert, jaccard, matroska, mixing, quotes, registry, rules, simple8b, spans, sql, templates
from tessarix.llm.common import cut, table

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row int, n int, size int"


@pytest.fixture(scope="module")
def odd(spark):
    base = " ".join(f"w{i}" for i in range(60)) + "."
    rows = [(1, base), (2, base), (2, base), (3, base + " x"), (4, None), (5, ""), (6, "One two"), (7, "one TWO"), (8, "  \n\t"), (9, "long " * 30_000), (10, base.upper())]
    return spark.createDataFrame([(i, t, "en", None if i % 3 == 0 else f"s{i % 2}", 0, 7, 7, 7) for i, t in rows], DOCS)


def slow_components(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}
    links = [(i, j) for i, a in sets.items() for j, b in sets.items() if i > j and a and 75 * max(len(a), len(b)) <= 100 * min(len(a), len(b)) and 100 * len(a & b) >= 75 * len(a | b)]
    while any(root[i] != root[j] for i, j in links):
        for i, j in links:
            root[i] = root[j] = min(root[i], root[j])
    return {i: (len(sets[i]), root[i]) for i in sets}


def test_jaccard(spark, odd):
    got = jaccard.near_duplicates(odd).collect()
    want = slow_components([(r.doc_id, r.text) for r in odd.collect()])
    assert len(got) == odd.count() and {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert jaccard.near_duplicates(odd.limit(0)).count() == 0
    docs = table(spark, SF, "documents")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect()}
    assert got == slow_components([(r.doc_id, r.text) for r in docs.collect()])


def test_near_family_and_common_passage(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    base = [words[i] for i in rng.integers(0, 400, 120)]
    rows = []
    for i in range(120):
        w = list(base)
        for k in rng.integers(0, 120, i % 5):
            w[k] = f"e{i}x{k}"
        rows.append((i, " ".join(w)))
    rows += [(500 + i, " ".join([f"u{i}y{k}" for k in range(30)] + base[:55])) for i in range(60)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == slow_components(rows)


def test_family_of_distant_members(spark, monkeypatch):
    """Members that resemble the base and not each other: few pairs meet on whole sets, and no link is lost."""
    rng = np.random.default_rng(5)
    base, rows, seen = [f"w{i}" for i in range(200)], [], []
    for i in range(400):
        w = list(base)
        for k in rng.choice(200, 5, replace=False):
            w[k] = f"e{i}x{k}"
        rows.append((i, " ".join(w)))
    whole = jaccard.verified
    monkeypatch.setattr(jaccard, "verified", lambda pairs, *rest: (seen.append(pairs.count()), whole(pairs, *rest))[1])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == slow_components(rows) and len(seen) == 2 and seen[1] < 5_000


def test_spans(spark, odd):
    passage = "The quick brown fox jumps over the lazy dog again today. It then runs home through the wide green forest. Nobody ever sees it there after the long dark night. Some people say that it was never real at all."
    docs = spark.createDataFrame([(1, f"Own start here. {passage}\nOwn end."), (2, f"Another beginning stands here. {passage}"), (3, "Clean text. Nothing repeats here."), (4, None)], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_removed) for r in spans.dedup(docs).collect()}
    assert got[1][1] == 0 and got[3] == ("Clean text. Nothing repeats here.", 0) and got[4][0] is None
    assert got[2][0].strip() == "Another beginning stands here." and got[2][1] >= 4
    out = spans.dedup(odd)
    assert out.count() == odd.count() and set(odd.columns) < set(out.columns) and spans.dedup(odd.limit(0)).count() == 0


def test_every_short_run(spark):
    """Without a least number of words every repeated run of two sentences goes, by brute force over all pairs of sentences."""
    rng = np.random.default_rng(12)
    said = [f"{a} {b}." for a in ("We", "He", "She") for b in ("ate", "sat", "went home", "met at noon")]
    rows = [(i, " ".join(said[k] for k in rng.integers(0, 12, 1 + i % 7))) for i in range(60)] + [(100, "We met at noon. He ate rice. She drank tea."), (101, "Before. We met at noon. He ate rice. She drank tea.")]
    known, want = set(), {}
    for i, text in rows:
        cut_up = spans.sentences(text)
        words = [s.strip().lower() for s in cut_up]
        lost = set()
        for k in range(len(words) - 1):
            run = tuple(words[k : k + 2])
            lost |= {k, k + 1} if run in known else set()
            known.add(run)
        want[i] = "".join(s for k, s in enumerate(cut_up) if k not in lost)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.text for r in spans.dedup(docs, least_words=0).collect()} == want and want[101] == "Before. "
    assert all(r.n_removed == 0 for r in spans.dedup(docs).collect())


def slow_spans(rows):
    """Text without the sentences of any place of a span but its first, by doc_id; rows have one doc_id each."""
    known, out = set(), {}
    for i, text in sorted(rows):
        cut = slow_sentences(text or "")
        lead = len([p for p, w in cut if not w])
        words = [w for _, w in cut if w]
        gone = set()
        for a, b in pairs_of(list(map(len, words))):
            key = tuple(map(tuple, words[a:b]))
            gone |= set(range(a + lead, b + lead)) if key in known else set()
            known.add(key)
        out[i] = (text if not gone else "".join(p for k, (p, _) in enumerate(cut) if k not in gone), len(gone))
    return out


def test_spans_by_brute_force(spark):
    line = "Some words that come again and again in one and the same text until nobody reads them.\n"
    own = "Here stands a passage of its own, which only this text has and no other one.\nIt goes on for another line before the rest begins.\n"
    rows = [(1, own + line * 300), (2, line * 50), (3, line), (4, f"{line}Not the same. {line}{line}{line}"), (5, None)]
    rows += [(100 + r.doc_id, r.text) for r in table(spark, SF, "documents").select("doc_id", "text").dropDuplicates(["doc_id"]).collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.text, r.n_removed) for r in spans.dedup(docs).collect()} == slow_spans(rows)
    assert spans.spans(docs.where("doc_id < 5").withColumn("row", F.lit(0))).groupBy("hash", "doc_id").count().agg(F.max("count")).first()[0] == 1


def test_mixing(spark, odd):
    for docs in (odd, table(spark, SF, "documents")):
        rows = mixing.mix(docs).collect()
        assert len(rows) == docs.count() and sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(docs).collect()))
        total, sources = sum(r["size"] for r in rows), sorted({r.source for r in rows}, key=lambda s: (s is None, s))
        held = {s: sum(r["size"] for r in rows if r.source == s) for s in sources}
        target, open_ = dict.fromkeys(sources, 0.0), set(sources)
        left = float(total)
        while left > 1e-6 and open_:
            weight = {s: sources.index(s) % 3 + 1 for s in open_}
            share = {s: left * weight[s] / sum(weight.values()) for s in open_}
            left = 0.0
            for s in list(open_):
                target[s] += share[s]
                if target[s] >= 3 * held[s]:
                    left += target[s] - 3 * held[s]
                    target[s] = 3.0 * held[s]
                    open_.discard(s)
        for r in rows:
            assert r.source_size == held[r.source] and abs(r.target - target[r.source]) < 1e-4 and 0 <= r.taken <= 3 * r["size"]
        for s in sources:
            assert abs(sum(r.taken for r in rows if r.source == s) - target[s]) <= 1
    assert mixing.mix(odd.limit(0)).count() == 0


def test_templates_and_media(spark, odd):
    assert templates.scan(odd).count() == odd.count()
    one = templates.scan(spark.createDataFrame([(1, "Licensed under the Apache License, Version 2.0. GNU General Public License gnu general public license")], "doc_id long, text string")).first()
    assert (one.n_base, one.first_word, one.last_word, one.base_labels, one.labels) == (3, 3, 12, "apache,gpl", "apache,apache-2.0,gpl")
    back = matroska.read_track(matroska.packets(matroska.store(odd), keep=["doc_id", "media"])).collect()
    want = {r.doc_id: (lambda b: b + bytes(-len(b) % 64 or 64 * (not b)))((r.text or "").encode()) for r in odd.collect()}
    assert len(back) == odd.count() and all(bytes(r.payload) == want[r.doc_id] for r in back)


def test_simple8b(spark, odd, tmp_path):
    from tokenizers import Tokenizer

    simple8b.write(odd, public_tokenizers.path("word_bpe_49k.json"), str(tmp_path / "ids"), block_ids=100)
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in simple8b.report(spark, str(tmp_path / "ids")).collect())
    whole, start, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for r in sorted(odd.collect(), key=lambda r: (r.doc_id, r.text or "")):
        ids = whole.encode(r.text or "", add_special_tokens=False).ids + [1]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == sorted(want)


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 16)).round(3)
    x[5] = 0
    x[50:90] = x[49]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(601, None), (602, [float("nan")] * 16), (603, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = hilbert.neighbours(df, F.col("vec_id") % 20 == 0, k=10, window=64, block=64, curves=8).collect()
    hit = total = 0
    for q in range(0, 600, 20):
        s = x @ x[q]
        order = [i for i in np.lexsort((np.arange(600), -s)) if i not in (q, 5)][:10]
        mine = sorted((r["rank"], r.vec_id) for r in got if r.query_id == q)
        assert [r for r, _ in mine] == list(range(1, 11))
        hit += len({v for _, v in mine} & set(order))
        total += 10
    assert hit / total > 0.6  # small windows; the whole table is within a window of production size
    exact = hilbert.neighbours(df, F.col("vec_id") % 20 == 0, k=10).collect()
    s = x @ x[60]
    assert [r.vec_id for r in sorted((r for r in exact if r.query_id == 60), key=lambda r: r["rank"])] == [49, *range(50, 59)]
    assert hilbert.neighbours(df.limit(0), F.lit(True)).count() == 0


@pytest.mark.parametrize("name", sorted(sql.ORACLES))
def test_by_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = con.execute(sql.ORACLES[name])
    names = [c[0] for c in found.description]
    assert len(want := found.fetchall()) > 100
    got = registry.QUERIES[name](spark, SF).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_any_column_names(spark, odd):
    """Columns of the input named like those that operators use inside are carried along."""
    names = ["row", "name", "mark", "ranges", "size", "held", "times", "again", "place", "bad", "_row", "_size", "_gone", "origin"]
    wide = odd.select("doc_id", "text", "lang", "source", "n_chars", *[F.concat(F.lit(c), "doc_id").alias(c) for c in names])
    for made in (spans.dedup(wide).drop("n_removed"), mixing.copies(wide), jaccard.one_of_each(wide), corpus_pipeline.near_duplicates(spark, wide, SF), corpus_pipeline.quality(spark, wide, SF)):
        assert made.columns == wide.columns
        assert all(r[c] == f"{c}{r.doc_id}" for r in made.collect() for c in names)


def test_edges(spark, odd):
    """Nulls, empty texts and empty tables in the operators that work row by row."""
    none = spark.createDataFrame([(1, None), (2, ""), (None, "a b")], "doc_id long, text string")
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = {r.doc_id: r for r in bytebpe.encode(none, ranks, public_tokenizers.PATTERN, back=True).collect()}
    assert coded[1].ids == coded[2].ids == [] and bytes(coded[1].decoded) == b"" and bytes(coded[None].decoded) == b"a b" and coded[None].ends[-1] == 3
    lists = spark.createDataFrame([(1, None), (2, []), (3, coded[None].ids)], "doc_id long, ids array<int>")
    assert {r.doc_id: bytes(r.decoded) for r in bytebpe.decode(lists, ranks, public_tokenizers.PATTERN).collect()} == {1: b"", 2: b"", 3: b"a b"}
    empty = {r.doc_id: r for r in bytebpe.round_trip(odd, ranks, public_tokenizers.PATTERN).collect()}
    tik = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(ranks), special_tokens={})
    for r in odd.select("doc_id", "text").distinct().collect():
        ids = tik.encode_ordinary(r.text or "")
        digests = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
        assert tuple(empty[r.doc_id])[1:4] == digests
    seen = {r.doc_id: r for r in templates.scan(none).collect()}
    assert seen[1].n_words == seen[2].n_words == 0 and seen[1].first_word is None and seen[None].n_words == 2
    media = {r.doc_id: r for r in matroska.digests(none).collect()}
    for key, raw in ((1, b""), (2, b""), (None, b"a b")):
        padded = raw + bytes(64 - len(raw))
        assert (media[key].n_bytes, media[key].payload_bytes, media[key].payload_sha256, media[key].tail_crc32) == (len(raw), 64, hashlib.sha256(padded).hexdigest(), zlib.crc32(padded))
    assert media[1].media_sha256 == media[2].media_sha256 and media[1].feature == media[2].feature
    labels = spark.createDataFrame([(1, 1), (2, None)], "doc_id long, quality int")
    scored = rules.classify(none, labels).collect()
    assert len(scored) == 3 and all(0 <= r.score <= 1 for r in scored)
    nothing = none.limit(0)
    for made in (bytebpe.round_trip(nothing, ranks, public_tokenizers.PATTERN), templates.scan(nothing), matroska.digests(nothing), rules.classify(nothing, labels)):
        assert made.count() == 0


def slow_base(text):
    """n_words, n_base, first, last, labels of op6 by plain search."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    at = [(i, label) for p, label in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def test_templates_by_brute_force(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in templates.query(spark, "/root/testdata/sf0.01").collect()}
    want = {r.doc_id: slow_base(r.text) for r in docs.collect()}
    assert got == want and any(w[1] for w in want.values())


def test_rules_held_out(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    scored = rules.classify(docs, labels)
    seen = scored.join(labels, "doc_id").where("held_out").select("predicted", "quality").collect()
    assert np.mean([r.predicted == r.quality for r in seen]) > 0.95
    assert scored.count() == docs.count() and rules.classify(docs, labels.limit(0)).select("score").distinct().collect()[0][0] == 0.5


def slow_conversations(rows):
    """Rows (conv, turn, role, text) with distinct texts in a conversation, one conversation after the other."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        parts = [quotes.levels(t or "") for *_, t in own]
        said = [{h for level, p in x if not level for h in quotes.hashes(p)} for x in parts]
        parent, linked = [], []
        for i, x in enumerate(parts):
            found = [(level, -j) for level, p in x if level for h in quotes.hashes(p) for j in [min((j for j in range(len(own)) if h in said[j]), default=len(own))] if j < i]
            linked.append(len(found))
            parent.append(-min(found)[1] if found else None)
        order = []

        def visit(i, depth, root):
            order.append((i, depth, root))
            for k in range(len(own)):
                if parent[k] == i:
                    visit(k, depth + 1, root)

        for i in range(len(own)):
            if parent[i] is None:
                visit(i, 0, i)
        for n, (i, depth, root) in enumerate(order):
            out[conv, i + 1] = (own[i][1], None if parent[i] is None else own[parent[i]][1], own[root][1], depth, n + 1, linked[i])
    return out


def test_quotes(spark):
    kind = "conv_id long, turn int, role string, text string"
    rows = [(1, 0, "a", "Is it true? I wonder about it."), (1, 1, "b", "No idea."), (1, 2, "a", "> Is it true? I wonder\n> about it.\nYes it is."), (1, 3, "b", ">> I wonder about it.\n> Yes it is.\nThanks."), (2, 0, "a", None), (None, 1, "a", "x"), (2, 0, "a", None)]
    got = {(r.conv_id, r.place): r for r in quotes.conversations(spark.createDataFrame(rows, kind)).collect()}
    assert len(got) == len(rows)
    assert got[1, 3].parent_turn == 0 and got[1, 3].text == "Yes it is." and got[1, 3].depth == 1
    assert got[1, 4].parent_turn == 2 and got[1, 4].text == "Thanks." and got[1, 4].depth == 2 and got[1, 4].root_turn == 0
    assert got[1, 2].parent_turn is None and got[1, 2].reply_order == 4 and got[2, 1].parent_turn is None
    # message 3 answers 1 and message 4 answers 2: threads come whole
    threads = [(7, 1, "a", "First of all we should meet."), (7, 2, "b", "Second of all we should eat."), (7, 3, "a", "> First of all we should meet.\nWhere?"), (7, 4, "b", "> Second of all we should eat.\nWhat?")]
    got = {r.turn: r.reply_order for r in quotes.conversations(spark.createDataFrame(threads, kind)).collect()}
    assert [t for t, _ in sorted(got.items(), key=lambda x: x[1])] == [1, 3, 2, 4]
    rng = np.random.default_rng(2)
    many = []
    for conv in (*range(12), None):
        said = []
        for turn in range(int(rng.integers(1, 30))):
            text = f"Message {turn} of {conv} says its own words. It ends here{turn}."
            for _ in range(int(rng.integers(0, 3))):
                if said:
                    text = "\n".join(">" * int(rng.integers(1, 3)) + " " + line for line in said[int(rng.integers(len(said)))].split("\n")) + "\n" + text
            said.append(text)
            many.append((conv, turn, "a", text))
    many += [(99, t, "a", "Thanks." if t else "Thanks. And one thing more for you.") for t in range(5)]
    want = slow_conversations(many)
    got = {(r.conv_id, r.place): (r.turn, r.parent_turn, r.root_turn, r.depth, r.reply_order, r.n_linked) for r in quotes.conversations(spark.createDataFrame(many, kind)).collect()}
    assert got == want and any(v[4] != k[1] for k, v in want.items()) and max(v[3] for v in want.values()) > 3
    assert quotes.conversations(spark.createDataFrame([], kind)).count() == 0


def test_pipeline(spark):
    """Each stage on all that the one before kept, held against what its operator or brute force says."""
    docs, stages = table(spark, SF, "documents"), dict(corpus_pipeline.STAGES)
    scored = {r.doc_id: r.predicted for r in rules.query(spark, SF).collect()}
    first = cut(stages["quality"](spark, docs, SF))
    assert first.columns == docs.columns and {r.doc_id for r in first.collect()} == {i for i, p in scored.items() if p} != set(scored)
    second = cut(stages["near_duplicates"](spark, first, SF))
    want = slow_components([(r.doc_id, r.text) for r in first.collect()])
    assert sorted(r.doc_id for r in second.collect()) == sorted(i for i, (_, root) in want.items() if root == i) and second.columns == docs.columns
    third = cut(stages["repeated_spans"](spark, second, SF))
    slow = slow_spans([(r.doc_id, r.text) for r in second.collect()])
    kept = {i: t for i, (t, n) in slow.items() if not n or t.strip()}
    assert {r.doc_id: r.text for r in third.collect()} == kept and third.columns == docs.columns
    assert all(r.n_chars == len(r.text) for r in third.collect() if slow[r.doc_id][1])
    fourth = cut(stages["mixture"](spark, third, SF))
    taken = {r.doc_id: int(r.taken / r["size"] + 0.5) if r["size"] else 0 for r in mixing.mix(third).collect()}
    assert {r.doc_id: r["count"] for r in fourth.groupBy("doc_id").count().collect()} == {i: n for i, n in taken.items() if n} and fourth.columns == docs.columns
    last = stages["tokens"](spark, fourth, SF).collect()
    tik = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    assert sorted((r.doc_id, r.n_tokens) for r in last) == sorted((r.doc_id, len(tik.encode_ordinary(r.text))) for r in fourth.collect())
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, last))


def recall(rows, got, asked, k):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    hit = 0
    for q in asked:
        s = x @ x[q]
        s[q] = -np.inf
        hit += len({int(ids[i]) for i in np.lexsort((ids, -s))[:k]} & got.get(q, set()))
    return hit / (k * len(asked))


def test_neighbours_window_follows_the_table(spark, monkeypatch):
    """Rows many times a window: near-isotropic and clustered vectors reach the recall alike, the second with less work."""
    rng = np.random.default_rng(5)
    n, chosen, choose = 24_000, [], hilbert.choose
    monkeypatch.setattr(hilbert, "choose", lambda *a: chosen.append((*choose(*a), a[1])) or chosen[-1][:2])
    flat = rng.normal(size=(n, 32))
    centres = rng.normal(size=(300, 32))
    grouped = centres[rng.integers(0, 300, n)] + 0.05 * rng.normal(size=(n, 32))
    for x in (flat, grouped):
        rows = [(i, v.tolist()) for i, v in enumerate(x)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        got = {}
        for r in hilbert.neighbours(df, F.col("vec_id") % 100 == 0, k=10, block=256).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        assert recall(rows, got, range(0, n, 100), 10) > 0.95
    (_, wide, total), (curves, narrow, _) = chosen
    assert wide > n // 4 and curves * 2 * narrow < 2 * total // 3
