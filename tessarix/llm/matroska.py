"""Media columns in Matroska: a writer for sample tracks and a parser that gives packet tables.

The parser reads variable-length EBML sizes (unknown sizes too), clusters, SimpleBlocks and BlockGroups with Xiph, EBML
and fixed lacing, and cues; each packet has its track, timestamp in milliseconds (by the file's TimestampScale; laced ones
by the track's default duration), cluster, byte range and key flag, each cue the cluster that stands where it points, -1
if none does. The writer stores a payload as one audio track of 8-bit samples.

Defined results: null media give no packets; broken media end at the first element that can't be read, with what came
before; a null text is stored as an empty one. Equal rows give equal results, an empty table an empty result; only the
named columns are read. Texts are stored whole.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_batches, plus, schema_of, slices, table

# Element ids of the format: fixed values.
EBML, SEGMENT, INFO, TRACKS, ENTRY, AUDIO, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0xE1, 0x1F43B675, 0x1C53BB6B
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0xE7, 0xA3, 0xA0, 0xA1
CUE_POINT, CUE_TIME, CUE_PLACE, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
NUMBER, DURATION, SCALE = 0xD7, 0x23E383, 0x2AD7B1
_INSIDE = {SEGMENT, BLOCK_GROUP, INFO, TRACKS, ENTRY}
#: Samples of a packet and a second, packets laced in a block, blocks of a cluster.
SAMPLES, RATE, LACED, BLOCKS = 512, 8000, 8, 16
PACKETS = "packets array<struct<track:int,timestamp:bigint,cluster:int,start:bigint,size:bigint,key:boolean,lacing:int>>, cues array<struct<time:bigint,track:int,position:bigint,cluster:int>>"


def _id(x: int) -> bytes:
    return x.to_bytes((x.bit_length() + 7) // 8, "big")


def _size(n: int) -> bytes:
    width = next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(kind: int, body: bytes) -> bytes:
    return _id(kind) + _size(len(body)) + body


def uint(kind: int, n: int) -> bytes:
    return element(kind, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


_HEAD = element(EBML, uint(0x4286, 1) + uint(0x42F7, 1) + uint(0x42F2, 4) + uint(0x42F3, 8) + element(0x4282, b"matroska") + uint(0x4287, 4) + uint(0x4285, 2))
_INFO = element(INFO, uint(SCALE, 1_000_000) + element(0x4D80, b"tessarix") + element(0x5741, b"tessarix"))
_TRACKS = element(TRACKS, element(ENTRY, uint(NUMBER, 1) + uint(DURATION, SAMPLES * 1_000_000_000 // RATE) + uint(0x73C5, 1) + uint(0x83, 2) + element(0x86, b"A_PCM/INT/LIT") + element(AUDIO, element(0xB5, struct.pack(">d", RATE)) + uint(0x9F, 1) + uint(0x6264, 8))))


def _block(frames: list[bytes], relative: int) -> bytes:
    """A SimpleBlock of track 1; equal frames are laced with fixed sizes, others with EBML sizes."""
    head = b"\x81" + struct.pack(">h", relative)
    if len(frames) == 1:
        return element(SIMPLE_BLOCK, head + b"\x80" + frames[0])
    sizes = [len(f) for f in frames]
    if len(set(sizes)) == 1:
        return element(SIMPLE_BLOCK, head + b"\x84" + bytes([len(frames) - 1]) + b"".join(frames))
    lace = _size(sizes[0])
    for before, now in zip(sizes[:-2], sizes[1:-1], strict=True):
        width = next(w for w in range(1, 9) if abs(now - before) < 1 << 7 * w - 1)
        lace += (now - before + (1 << 7 * width - 1) - 1 | 1 << 7 * width).to_bytes(width, "big")
    return element(SIMPLE_BLOCK, head + b"\x86" + bytes([len(frames) - 1]) + lace + b"".join(frames))


def mux(payload: bytes) -> bytes:
    """``payload`` as a Matroska file with one track of 8-bit samples."""
    frames = [payload[i : i + SAMPLES] for i in range(0, len(payload), SAMPLES)]
    body, cues, step, place = [_INFO, _TRACKS], [], LACED * BLOCKS, len(_INFO) + len(_TRACKS)
    for i in range(0, len(frames), step):
        began = i * SAMPLES * 1000 // RATE
        blocks = [_block(frames[j : min(j + LACED, i + step)], j * SAMPLES * 1000 // RATE - began) for j in range(i, min(i + step, len(frames)), LACED)]
        cluster = element(CLUSTER, uint(TIMESTAMP, began) + b"".join(blocks))
        cues.append(element(CUE_POINT, uint(CUE_TIME, began) + element(CUE_PLACE, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER, place))))
        body.append(cluster)
        place += len(cluster)
    return _HEAD + element(SEGMENT, b"".join(body) + element(CUES, b"".join(cues)))


def _vint(data: bytes, at: int, keep: bool) -> tuple[int, int]:
    """A variable-length number and where it ends; an unknown size is -1."""
    first = data[at]
    width = 9 - first.bit_length()
    if width > 8 or at + width > len(data):
        raise ValueError("no number here")
    n = int.from_bytes(data[at : at + width], "big")
    if keep:
        return n, at + width
    n &= (1 << 7 * width) - 1
    return (-1 if n == (1 << 7 * width) - 1 else n), at + width


def _laces(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """Start and size of each frame of a block whose frames begin at ``at``."""
    if not kind:
        return [(at, end - at)]
    count, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if kind == 2:
        if (end - at) % count:
            raise ValueError("frames of one size don't fill the block")
        sizes = [(end - at) // count] * count
    elif kind == 1:
        for _ in range(count - 1):
            n = 0
            while data[at] == 255:
                n, at = n + 255, at + 1
            sizes.append(n + data[at])
            at += 1
    else:
        for i in range(count - 1):
            n, after = _vint(data, at, False)
            sizes.append(n if not i else sizes[-1] + n - ((1 << 7 * (after - at) - 1) - 1))
            at = after
    if kind != 2:
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("frames run over the block")
    out = []
    for n in sizes:
        out.append((at, n))
        at += n
    return out


def demux(data: bytes) -> tuple[list[tuple], list[tuple]]:
    """Packets (track, timestamp, cluster, start, size, key, lacing) and cues (time, track, position, cluster)."""
    packets: list[tuple] = []
    cues: list[tuple] = []
    base = cluster = -1
    entry, durations, scale = 0, {}, 1_000_000
    segment, begins = 0, {}
    stack = [(0, len(data))]
    time = track = 0

    def block(at: int, end: int, simple: bool) -> None:
        number, at = _vint(data, at, False)
        (relative,) = struct.unpack_from(">h", data, at)
        flags = data[at + 2]
        for i, (start, n) in enumerate(_laces(data, at + 3, end, flags >> 1 & 3)):
            packets.append((number, ((base + relative) * scale + i * durations.get(number, 0)) // 1_000_000, cluster, start, n, bool(flags & 128) if simple else None, flags >> 1 & 3))

    try:
        while stack:
            at, end = stack.pop()
            while at < end:
                kind, body = _vint(data, at, True)
                n, body = _vint(data, body, False)
                stop = end if n < 0 else body + n
                if stop > end:
                    break
                if kind == SEGMENT:
                    segment = body
                if kind == CLUSTER:
                    cluster += 1
                    begins[at - segment] = cluster
                if kind in _INSIDE or kind in (CLUSTER, CUES, CUE_POINT, CUE_PLACE):
                    stack.append((stop, end))
                    at, end = body, stop
                    continue
                if kind == NUMBER:
                    entry = int.from_bytes(data[body:stop], "big")
                elif kind == DURATION:
                    durations[entry] = int.from_bytes(data[body:stop], "big")
                elif kind == SCALE:
                    scale = int.from_bytes(data[body:stop], "big")
                elif kind == TIMESTAMP:
                    base = int.from_bytes(data[body:stop], "big")
                elif kind in (SIMPLE_BLOCK, BLOCK):
                    block(body, stop, kind == SIMPLE_BLOCK)
                elif kind == CUE_TIME:
                    time = int.from_bytes(data[body:stop], "big")
                elif kind == CUE_TRACK:
                    track = int.from_bytes(data[body:stop], "big")
                elif kind == CUE_CLUSTER:
                    cues.append((time * scale // 1_000_000, track, int.from_bytes(data[body:stop], "big")))
                at = stop
    except (ValueError, IndexError, struct.error):
        pass
    return packets, [(*c, begins.get(c[2], -1)) for c in cues]


def store(df: DataFrame, text: str = "text", keep: list[str] = ["doc_id"]) -> DataFrame:  # noqa: B006
    """``keep``, n_bytes and media: the UTF-8 bytes of the text, filled up with zeros to a positive multiple of 64, as Matroska."""

    def run(batches):
        for batch in slices(batches, text):
            raw = [(t or "").encode() for t in batch.column(text).to_pylist()]
            media = [mux(r + bytes(-len(r) % 64 or 64 * (not r))) for r in raw]
            yield plus(batch, keep, n_bytes=pa.array(map(len, raw), pa.int64()), media=pa.array(media, pa.binary()))

    return in_batches(df.select(*keep, *[text][: text not in keep]), run, schema_of(df, keep, "n_bytes long, media binary"))


def packets(df: DataFrame, media: str = "media", keep: list[str] = ["doc_id"]) -> DataFrame:  # noqa: B006
    """``keep``, the packet table of each file and its cues."""
    names = ("track", "timestamp", "cluster", "start", "size", "key", "lacing")

    def run(batches):
        for batch in slices(batches, media):
            parsed = [demux(m) if m is not None else ([], []) for m in batch.column(media).to_pylist()]
            yield plus(batch, keep, packets=_structs([p for p, _ in parsed], names, (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int32())), cues=_structs([c for _, c in parsed], ("time", "track", "position", "cluster"), (pa.int64(), pa.int32(), pa.int64(), pa.int32())))

    return in_batches(df.select(*keep, *[media][: media not in keep]), run, schema_of(df, keep, PACKETS))


def _structs(rows: list[list[tuple]], names: tuple, kinds: tuple) -> pa.ListArray:
    flat = [x for r in rows for x in r]
    columns = list(zip(*flat, strict=True)) or [[]] * len(names)
    inner = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=list(names))
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), inner)


def read_track(df: DataFrame, track: int = 1, keep: list[str] = ["doc_id"]) -> DataFrame:  # noqa: B006
    """``keep``, payload: the bytes of the track's packets by their ranges in ``media``; feature: what its samples and packets show."""

    def run(batches):
        for batch in slices(batches, "media"):
            out, features = [], []
            column = batch.column("packets")
            ends, flat = column.offsets.to_numpy(), column.values
            cues = batch.column("cues").to_pylist()
            tracks, starts, sizes, times, clusters, laces = (flat.field(f).to_numpy(zero_copy_only=False) for f in ("track", "start", "size", "timestamp", "cluster", "lacing"))
            for media, cued, a, b in zip(batch.column("media").to_pylist(), cues, ends[:-1], ends[1:], strict=True):
                own = np.flatnonzero(tracks[a:b] == track) + a
                data = b"".join([media[s : s + n] for s, n in zip(starts[own].tolist(), sizes[own].tolist(), strict=True)])
                x = np.frombuffer(data, np.uint8).astype(np.int64)
                out.append(data)
                features.append(f"packets={len(own)};clusters={len(np.unique(clusters[own]))};cued={len({c["cluster"] for c in cued or [] if c["track"] == track and c["cluster"] >= 0})};laced={int((laces[own] > 0).sum())};last_ms={int(times[own].max()) if len(own) else 0};mean={x.mean() if len(x) else 0:.4f};crossings={int((np.diff((x >= 128).astype(np.int8)) != 0).sum())};range={int(x.min()) if len(x) else 0}-{int(x.max()) if len(x) else 0}")
            yield plus(batch, keep, payload=pa.array(out, pa.binary()), feature=pa.array(features, pa.string()))

    return in_batches(df.select(*keep, *[c for c in ("media", "packets", "cues") if c not in keep]), run, schema_of(df, keep, "payload binary, feature string"))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of each stored text."""
    stored = store(docs)
    parsed = packets(stored, keep=["doc_id", "n_bytes", "media"])
    sums = parsed.select("*", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"))
    back = read_track(sums, keep=["doc_id", "n_bytes", "media_bytes", "media_sha256"])
    return back.select("doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"), "media_bytes", "media_sha256", "feature")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
