"""The Spark-free helpers: round trips and brute force."""

import random
import re

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessarix.llm import bpe, common, hilbert, jaccard, matroska, quotes, simple8b, spans, templates

BYTES = bpe.ByteLevelCoder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
WORDS = bpe.WordCoder(P.path("word_bpe_49k.json"))
TIK = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
WHOLE = Tokenizer.from_file(P.path("word_bpe_49k.json"))
TEXTS = st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \t\n\r\x0b\x1c\x85 　aAzΣé'sreIL12!?.-日")), max_size=60)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_byte_level(text):
    ids = BYTES.encode(text)
    assert ids.tolist() == TIK.encode_ordinary(text)
    assert BYTES.decode(ids) == text.encode()


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_words(text):
    assert WORDS.encode(text).tolist() == WHOLE.encode(text, add_special_tokens=False).ids


def test_long_and_special():
    for text in ("a" * 50_000, " " * 5000 + "x", "<|endoftext|> it's", "a <|endoftext|> b<|startoftext|>c <|ENDOFTEXT|>", "=" * 999):
        assert BYTES.encode(text).tolist() == TIK.encode_ordinary(text)
        assert WORDS.encode(text).tolist() == WHOLE.encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXTS), max_size=8), st.integers(0, 3))
def test_many_texts_at_once(texts, skip):
    held = pa.array(texts, pa.string())[min(skip, len(texts)) :]
    whole = [t or "" for t in held.to_pylist()]
    ids, ends = BYTES.encode_all(held)
    parts = np.split(ids, ends[:-1]) if len(ends) else []
    assert [p.tolist() for p in parts] == [TIK.encode_ordinary(t) for t in whole]
    assert BYTES.decode_all(ids, ends).to_pylist() == [t.encode() for t in whole]
    if len(ids):
        assert [e.tolist() for e in np.split(BYTES.byte_ends(ids, ends), ends[:-1])] == [np.cumsum([len(TIK.decode_single_token_bytes(i)) for i in p]).tolist() for p in parts]
    ids, ends = WORDS.encode_all(held)
    assert [p.tolist() for p in (np.split(ids, ends[:-1]) if len(ends) else [])] == [WHOLE.encode(t, add_special_tokens=False).ids for t in whole]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50_000), st.integers(0, 2**64 - 1)), max_size=700))
def test_simple8b(ids):
    assert simple8b.unpack(simple8b.pack(np.array(ids, dtype=np.uint64))).tolist() == ids


def test_simple8b_is_small():
    assert len(simple8b.pack(np.zeros(2400, np.uint64))) == 32 + 8 * 10
    assert len(simple8b.pack(np.full(600, 1000, np.uint64))) == 32 + 8 * 100


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 70_000), st.integers(0, 5))
def test_matroska(size, seed):
    payload = random.Random(seed).randbytes(size)
    media = matroska.mux(payload)
    packets, cues = matroska.demux(media)
    assert b"".join(media[p[3] : p[3] + p[4]] for p in packets) == payload
    assert [p[1] for p in packets] == [i * 64 for i in range(len(packets))]
    body = media.index(b"\x18\x53\x80\x67")
    base = matroska._vint(media, body + 4, False)[1]
    assert all(media[base + c[2] : base + c[2] + 4] == b"\x1f\x43\xb6\x75" for c in cues)
    assert [c[3] for c in cues] == sorted({p[2] for p in packets})


def test_lacing_and_broken_media():
    def block(flags, body):
        return matroska._HEAD + matroska.element(matroska.SEGMENT, matroska.element(matroska.CLUSTER, matroska.uint(matroska.TIMESTAMP, 7) + matroska.element(matroska.SIMPLE_BLOCK, b"\x81\x00\x01" + flags + body)))

    scaled = matroska._HEAD + matroska.element(matroska.SEGMENT, matroska.element(matroska.INFO, matroska.uint(matroska.SCALE, 5_000_000)) + matroska.element(matroska.CLUSTER, matroska.uint(matroska.TIMESTAMP, 7) + matroska.element(matroska.SIMPLE_BLOCK, b"\x81\x00\x01\x00x")))
    assert matroska.demux(scaled)[0][0][1] == 40
    xiph = block(b"\x02", b"\x02\xff\x01\x02" + b"a" * 256 + b"bb" + b"ccc")
    assert [(p[1], p[4]) for p in matroska.demux(xiph)[0]] == [(8, 256), (8, 2), (8, 3)]
    ebml = block(b"\x06", b"\x02\x84\xbe" + b"aaaa" + b"bbb" + b"c")
    assert [p[4] for p in matroska.demux(ebml)[0]] == [4, 3, 1]
    assert matroska.demux(xiph[:-300])[0] == [] and matroska.demux(b"")[0] == [] and matroska.demux(b"\x00\xff")[0] == []
    unknown = matroska._HEAD + b"\x18\x53\x80\x67\x01\xff\xff\xff\xff\xff\xff\xff" + b"\x1f\x43\xb6\x75\xff" + matroska.uint(matroska.TIMESTAMP, 1) + matroska.element(matroska.SIMPLE_BLOCK, b"\x81\x00\x00\x80x")
    assert [p[1:5] for p in matroska.demux(unknown)[0]] == [(1, 0, len(unknown) - 1, 1)]


def test_hilbert_curve():
    n, bits = 2, 4
    cells = np.array([[x, y] for x in range(16) for y in range(16)])
    keys = hilbert.hilbert_keys(cells, bits)
    assert sorted(keys.tolist()) == list(range(256))
    walk = cells[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet=" \nABab c\té", max_size=40), max_size=6))
def test_shingles(texts):
    def slow(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate({c: c + 32 for c in range(65, 91)}))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    fast, want = jaccard.shingle_sets(pa.array(texts, pa.string())), [slow(t) for t in texts]
    assert [len(f) for f in fast] == [len(w) for w in want]
    for i in range(len(texts)):
        for j in range(i):
            assert len(np.intersect1d(fast[i], fast[j])) == len(want[i] & want[j])


def pairs_of(counts, doc=None):
    i, j = spans.runs(np.array(doc or [0] * len(counts)), np.array(counts, np.int64))
    return list(zip(i.tolist(), j.tolist(), strict=True))


def test_sentences_and_runs():
    for t in ("", "a.b c. D e!  F\n\n g", "...", "x " * 100, "\n a"):
        assert "".join(spans.sentences(t)) == t
    assert pairs_of([10, 10, 10, 10, 5]) == [(0, 2), (1, 3), (2, 4), (2, 5)]
    assert pairs_of([5, 5]) == [] and pairs_of([]) == [] and pairs_of([20]) == []
    assert pairs_of([10, 10, 10, 10], [0, 0, 1, 1]) == [(0, 2), (2, 4)]


def raw_hash(word):
    h = sum(int(common._BYTES[b]) * pow(int(common.BASE), k, 1 << 64) for k, b in enumerate(word.lower())) % (1 << 64)
    return int(common.mixed(np.array([h], np.uint64))[0])


def word_hash(word):
    return raw_hash(word.encode())


def slow_sentences(text):
    """Pieces and words by the rules, one text and one word at a time."""
    out = []
    for piece in filter(None, spans._SENTENCE.findall(text)):
        words = [(w, w.rstrip().lower() if w.isascii() else w.rstrip()) for w in spans._WORD.findall(piece)]
        if len(words) < spans.LONGEST:
            out.append((piece, [w for _, w in words]))
            continue
        hashes = [word_hash(w.rstrip()) for w, _ in words]
        marks = [int(common.mixed(np.array([(a * int(spans._FIRST) + b * int(spans._SECOND)) % (1 << 64)], np.uint64))[0]) >> 1 for a, b in zip(hashes, hashes[1:], strict=False)]
        at = [0, *[i for i in range(1, len(marks)) if marks[i] == min(marks[max(1, i - spans.NEAR) : i + spans.NEAR + 1])], len(words)]
        lead = piece[: len(piece) - len(piece.lstrip())]
        out += [(lead * (not i) + "".join(w for w, _ in words[i:j]), [w for _, w in words[i:j]]) for i, j in zip(at, at[1:], strict=False)]
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=" \n\t.!?。！」…é日本ไทยaB\xa0\x1c", max_size=160)), max_size=5))
def test_sentences_by_the_rules(texts):
    doc, number, begin, words, marks = spans.segmented(pa.array(texts, pa.string()))
    for d, text in enumerate(texts):
        slow = slow_sentences(text or "")
        raw = (text or "").encode()
        want = [(k, len(w)) for k, (_, w) in enumerate(slow) if w]
        assert [(int(a), int(b)) for a, b in zip(number[doc == d], words[doc == d], strict=True)] == want
        begins = begin[doc == d].tolist()
        if want:
            assert [raw[a:b].decode() for a, b in zip(begins, [*begins[1:], len(raw)], strict=True)] == [p for p, w in slow if w]
        if text:
            assert "".join(spans.sentences(text)) == text
    # a text has the same sentences and hashes however they are found
    ascii_only = pa.array([None if t is None else "".join(c for c in t if c in " \n\t.!?éaB") for t in texts], pa.string())
    for one, two in zip(spans.segmented(ascii_only), spans.segmented(ascii_only, plain=False), strict=True):
        assert one.tolist() == two.tolist()
    for k in range(len(marks)):
        for m in range(k):
            mine, other = ([w for _, w in [x for x in slow_sentences(texts[doc[q]] or "")][number[q] : number[q] + 1]][0] for q in (k, m))
            assert (marks[k] == marks[m]) == (["".join(c.lower() if c.isascii() else c for c in w) for w in mine] == ["".join(c.lower() if c.isascii() else c for c in w) for w in other])


def test_word_hashes_over_blocks(monkeypatch):
    rnd = random.Random(1)
    for block in (3, 4, 7, 1 << 17):
        monkeypatch.setattr(common, "_BLOCK", block)
        for _ in range(100):
            data = bytes(rnd.choice(b"aAb \nxyz\xc3\xa9") for _ in range(rnd.randrange(40)))
            begin, end, hashes = common.word_hashes(np.frombuffer(data, np.uint8))
            want = [m for m in re.finditer(rb"[^ \t-\r]+", data)]
            assert begin.tolist() == [m.start() for m in want] and end.tolist() == [m.end() for m in want]
            assert hashes.tolist() == [raw_hash(m[0]) for m in want]


def test_templates():
    a = templates.compile_template("under the <<opt>> very <<end>> big <<any 0-2>> license")
    for text, n in (("under the big license", 4), ("under the very big x y license", 7), ("under the big x y z license", 0), ("under the very license", 0)):
        assert a.accept(text.encode().split(), 0) == n
    a = templates.compile_template("<<opt>> is <<end>> <<opt>> hereby <<end>> licensed <<opt>> so <<end>>")
    for text, at, lead in (("this is hereby licensed so", 3, 2), ("is licensed", 1, 1), ("licensed", 0, 0), ("hereby is licensed", 2, 1)):
        assert a.accept(text.encode().split(), at) and a.lead(text.encode().split(), at) == lead
    for label in ("mit-text", "bsd-2-clause", "bsd-3-clause"):
        wording = templates.TEMPLATES[label]
        text = re.sub(r"<<any 0-1>>", "1", re.sub(r"<<opt>>.*?<<end>>", "", re.sub(r"<<any 1-12>>", "the authors", wording))).encode().split()
        assert [k for k, t in templates.TEMPLATES.items() if templates.compile_template(t).accept(text, 0) == len(text)] == [label]
        assert not templates.compile_template(wording).accept(text[:100] + [b"not"] + text[100:], 0)
    assert templates.places(b" mit license mit license ", b" mit license ") == [0, 2]


def test_quote_levels():
    text = "I agree.\nOn Monday, X wrote:\n> Is it so?\n>> First.\n> Yes.\nBye."
    assert quotes.levels(text) == [(0, "I agree."), (1, "Is it so?"), (2, "First."), (1, "Yes."), (0, "Bye.")]
    assert quotes.hashes("Is  it\nSO?") == quotes.hashes("is it so?")


def caught(a, b):
    """Words of ``b`` in runs that ``a`` has too."""
    def places(text):
        words = [w for _, w in slow_sentences(text) if w]
        return words, {(i, j): tuple(w for p in words[i:j] for w in p) for i, j in pairs_of(list(map(len, words)))}

    known, (words, found) = set(places(a)[1].values()), places(b)
    return sum(len(words[k]) for k in {k for (i, j), t in found.items() if t in known for k in range(i, j)})


def test_passages_at_any_offset():
    rnd = random.Random(7)
    shares = []
    for n in range(300):
        p = " ".join(f"w{rnd.randrange(5000)}" for _ in range(60))
        if n % 2:
            p = p.replace(" ", ". ", 30).replace(". ", " ", 29)
        own = [" ".join(f"{c}{rnd.randrange(5000)}" for _ in range(rnd.randrange(1, 40))) for c in "abcd"]
        shares.append(caught(f"{own[0]} {p} {own[1]}", f"{own[2]} {p.upper()} {own[3]}") / 60)
    assert min(shares) > 0 and sum(shares) / len(shares) > 0.7
    han = "".join(chr(0x4E00 + rnd.randrange(5000)) for _ in range(60))
    assert caught("甲乙丙" + han, "子丑" + han + "寅卯") > 30
    assert len(spans.sentences("今日は雨。明日は晴れ！")) == 2
    assert caught("one two " + "same " * 200, "three " + "same " * 300) > 250
