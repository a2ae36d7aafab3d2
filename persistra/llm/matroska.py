"""Matroska: write audio of 8-bit samples, parse files into packet tables.

The parser reads EBML elements with variable-length ids and sizes (unknown
sizes included), tracks, clusters, SimpleBlocks and BlockGroups, the three
kinds of lacing, and cues.  A packet is a frame with its track, timestamp (in
nanoseconds), cluster, key-frame flag and byte range in the file, so a
payload can be read without copying anything else.

The writer stores a payload as one track of unsigned 8-bit PCM, ``FRAME``
samples a frame, several frames a block with fixed-size lacing, a cue for each
cluster.  Nothing in the file depends on time or chance, so equal payloads
give equal files.

Defined cases.  Null text: as the empty text, which is one frame of padding.
Elements of other kinds, and elements where they do not belong, are skipped; a
float of no, four or eight bytes is read, of any other length it is zero; a
file that ends early or is broken gives the packets before that place.  Null
media has no packets.  Repeated rows give equal results.  A text of any length
is one row; its file must fit a worker several times over.  An empty table
gives an empty result.  Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from persistra.llm.base import lean

FRAME = 576
RATE = 8000
FRAMES_PER_BLOCK, BLOCKS_PER_CLUSTER = 8, 32

# fixed values: element ids of the format
EBML, SEGMENT, INFO, SCALE, TRACKS, TRACK, NUMBER, KIND, CODEC = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x2AD7B1, 0x1654AE6B, 0xAE, 0xD7, 0x83, 0x86
AUDIO, FREQUENCY, CHANNELS, DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIME, SIMPLE_BLOCK, GROUP, BLOCK, REFERENCE = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUES, CUE, CUE_TIME, CUE_PLACE, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
TOP_LEVEL = {SEGMENT, INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1043A770, 0x1254C367, 0x1941A469}
#: what is read inside what; nothing else is entered, so no file nests deeper than this
INSIDE = {None: {SEGMENT}, SEGMENT: {INFO, TRACKS, CLUSTER, CUES}, TRACKS: {TRACK}, TRACK: {AUDIO}, CLUSTER: {GROUP}, CUES: {CUE}, CUE: {CUE_PLACE}}


@dataclass
class Packet:
    track: int
    timestamp_ns: int
    cluster: int
    start: int
    size: int
    key: bool
    lacing: str


@dataclass
class Media:
    scale: int = 1_000_000
    tracks: dict[int, dict] = field(default_factory=dict)
    clusters: list[tuple[int, int]] = field(default_factory=list)  # place in the file, timestamp
    packets: list[Packet] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # time, track, place in the file


def read_id(buf: bytes, at: int) -> tuple[int, int]:
    n = 9 - buf[at].bit_length()
    return int.from_bytes(buf[at : at + n]), at + n


def read_size(buf: bytes, at: int) -> tuple[int | None, int]:
    """A size without its length marker; None for all ones (unknown)."""
    n = 9 - buf[at].bit_length()
    value = int.from_bytes(buf[at : at + n]) & ((1 << 7 * n) - 1)
    return (None if value == (1 << 7 * n) - 1 else value), at + n


def _lacing(buf: bytes, at: int, end: int, kind: int) -> tuple[str, list[int], int]:
    """Name, frame sizes, place of the first frame."""
    if kind == 0:
        return "none", [end - at], at
    count, at = buf[at] + 1, at + 1
    if kind == 2:
        return "fixed", [(end - at) // count] * count, at
    sizes = []
    if kind == 1:
        for _ in range(count - 1):
            size = 0
            while buf[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + buf[at])
            at += 1
        return "xiph", [*sizes, end - at - sum(sizes)], at
    for i in range(count - 1):
        n = 9 - buf[at].bit_length()
        value, at = int.from_bytes(buf[at : at + n]) & ((1 << 7 * n) - 1), at + n
        # the first is a size, the others are differences, stored with an offset
        sizes.append(value if i == 0 else sizes[-1] + value - ((1 << (7 * n - 1)) - 1))
    return "ebml", [*sizes, end - at - sum(sizes)], at


class Parser:
    def __init__(self, buf: bytes):
        self.buf, self.media = buf, Media()
        self.base = 0
        self.cluster_time = 0
        try:
            self._walk(0, len(buf), False, None)
        except IndexError:  # the file ends inside an element
            pass

    def _walk(self, at: int, end: int, open_ended: bool, parent: int | None, into: dict | None = None) -> int:
        buf, media = self.buf, self.media
        while at < end:
            head = at
            eid, at = read_id(buf, at)
            if open_ended and eid in TOP_LEVEL:
                return head
            size, at = read_size(buf, at)
            stop = end if size is None else min(at + size, end)
            if eid in INSIDE.get(parent, ()):
                inner: dict = {"refs": 0}
                if eid == SEGMENT:
                    self.base = at
                elif eid == CLUSTER:
                    media.clusters.append((head, 0))
                stop = self._walk(at, stop, size is None and eid != SEGMENT, eid, inner)
                if eid == TRACK and NUMBER in inner:
                    media.tracks[inner[NUMBER]] = {"kind": inner.get(KIND), "codec": inner.get(CODEC, ""), **{k: inner[k] for k in (FREQUENCY, CHANNELS, DEPTH) if k in inner}}
                elif eid == AUDIO and into is not None:
                    into.update({k: inner[k] for k in (FREQUENCY, CHANNELS, DEPTH) if k in inner})
                elif eid == GROUP and BLOCK in inner:
                    self._block(*inner[BLOCK], key=not inner["refs"], simple=False)
                elif eid == CUE_PLACE and into is not None:
                    into.setdefault("places", []).append((inner.get(CUE_TRACK, 0), self.base + inner.get(CUE_CLUSTER, 0)))
                elif eid == CUE:
                    media.cues += [(inner.get(CUE_TIME, 0), *p) for p in inner.get("places", [])]
            elif eid == SIMPLE_BLOCK and parent == CLUSTER and at + (size or 0) <= end:
                self._block(at, stop, key=False, simple=True)
            elif into is not None:
                if eid == BLOCK:
                    into[BLOCK] = (at, stop)
                elif eid == REFERENCE:
                    into["refs"] += 1
                elif eid == CODEC:
                    into[CODEC] = buf[at:stop].decode("ascii", "replace")
                elif eid == FREQUENCY:
                    into[FREQUENCY] = struct.unpack({4: ">f", 8: ">d"}[stop - at], buf[at:stop])[0] if stop - at in (4, 8) else 0.0
                elif stop - at <= 8:
                    into[eid] = value = int.from_bytes(buf[at:stop])
                    if eid == SCALE:
                        media.scale = value
                    elif eid == TIME:
                        self.cluster_time = value
                        if media.clusters:
                            media.clusters[-1] = (media.clusters[-1][0], value)
            at = stop
        return at

    def _block(self, at: int, end: int, key: bool, simple: bool) -> None:
        track, at = read_size(self.buf, at)
        relative = int.from_bytes(self.buf[at : at + 2], signed=True)
        flags, at = self.buf[at + 2], at + 3
        lacing, sizes, at = _lacing(self.buf, at, end, flags >> 1 & 3)
        if min(sizes) < 0 or at + sum(sizes) > end:  # sizes that do not fit the block
            return
        time = (self.cluster_time + relative) * self.media.scale
        info = self.media.tracks.get(track, {})
        # laced frames of PCM follow each other by their sample counts
        per = info.get(CHANNELS, 1) * info.get(DEPTH, 8) // 8 * info.get(FREQUENCY, 0) if info.get(CODEC, info.get("codec", "")).startswith("A_PCM") else 0
        past = 0
        for size in sizes:
            self.media.packets.append(Packet(track, time + (int(past * 1_000_000_000 / per) if per else 0), len(self.media.clusters) - 1, at, size, bool(flags & 0x80) if simple else key, lacing))
            at, past = at + size, past + size


def parse(buf: bytes) -> Media:
    return Parser(buf).media


def _size(n: int) -> bytes:
    length = next(k for k in range(1, 9) if n < (1 << 7 * k) - 1)
    return ((1 << 7 * length) | n).to_bytes(length)


def element(eid: int, body: bytes) -> bytes:
    return eid.to_bytes((eid.bit_length() + 7) // 8) + _size(len(body)) + body


def _uint(eid: int, n: int) -> bytes:
    return element(eid, n.to_bytes(max(1, (n.bit_length() + 7) // 8)))


def _header() -> tuple[bytes, bytes]:
    head = element(EBML, _uint(0x4286, 1) + _uint(0x42F7, 1) + _uint(0x42F2, 4) + _uint(0x42F3, 8) + element(0x4282, b"matroska") + _uint(0x4287, 4) + _uint(0x4285, 2))
    info = element(INFO, _uint(SCALE, 1_000_000) + element(0x4D80, b"persistra") + element(0x5741, b"persistra"))
    audio = element(AUDIO, element(FREQUENCY, struct.pack(">f", RATE)) + _uint(CHANNELS, 1) + _uint(DEPTH, 8))
    track = element(TRACK, _uint(NUMBER, 1) + _uint(0x73C5, 1) + _uint(KIND, 2) + _uint(0x9C, 1) + element(CODEC, b"A_PCM/INT/LIT") + audio)
    return head, info + element(TRACKS, track)


_HEAD, _PREFIX = _header()


def write(payload: bytes) -> bytes:
    """payload: a multiple of FRAME bytes."""
    ms = FRAME * 1000 // RATE
    parts, cues, at = [_PREFIX], [], len(_PREFIX)
    frames = len(payload) // FRAME
    for first in range(0, frames, FRAMES_PER_BLOCK * BLOCKS_PER_CLUSTER):
        blocks = [_uint(TIME, first * ms)]
        for f in range(first, min(frames, first + FRAMES_PER_BLOCK * BLOCKS_PER_CLUSTER), FRAMES_PER_BLOCK):
            n = min(FRAMES_PER_BLOCK, frames - f)
            relative = ((f - first) * ms).to_bytes(2, signed=True)
            flags = b"\x80" if n == 1 else bytes([0x84, n - 1])
            blocks.append(element(SIMPLE_BLOCK, b"\x81" + relative + flags + payload[f * FRAME : (f + n) * FRAME]))
        cluster = element(CLUSTER, b"".join(blocks))
        cues.append(element(CUE, _uint(CUE_TIME, first * ms) + element(CUE_PLACE, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER, at))))
        parts.append(cluster)
        at += len(cluster)
    return _HEAD + element(SEGMENT, b"".join([*parts, element(CUES, b"".join(cues))]))


def padded(text: bytes) -> bytes:
    return text + b"\xff" * (max(1, -(-len(text) // FRAME)) * FRAME - len(text))


def feature(media: Media) -> str:
    """Tracks, clusters, cues that point at a cluster, packets by lacing, and the time of the last packet."""
    places = {at for at, _ in media.clusters}
    kinds = ",".join(f"{k}:{sum(p.lacing == k for p in media.packets)}" for k in ("none", "xiph", "fixed", "ebml"))
    end = max((p.timestamp_ns for p in media.packets), default=0)
    return f"tracks={len(media.tracks)};clusters={len(media.clusters)};cues={sum(c[2] in places for c in media.cues)};packets={len(media.packets)};lacing={kinds};last_ns={end}"


_STORED = [("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]


def _stored(text: bytes) -> tuple:
    stored = write(padded(text))
    media = parse(stored)
    back = b"".join(stored[p.start : p.start + p.size] for p in media.packets)
    return len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(media)


def _round_trip(batches):
    for batch in batches:
        rows = [_stored(t or b"") for t in batch.column("text").cast(pa.binary()).to_pylist()]
        columns = zip(*rows) if rows else [()] * len(_STORED)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, (_, t) in zip(columns, _STORED))], ["doc_id", *(n for n, _ in _STORED)])


def store_and_read_back(docs: DataFrame) -> DataFrame:
    """Texts as media, and what their packet tables give back."""
    ids = docs.schema["doc_id"].dataType.simpleString()
    return lean(docs).select("doc_id", "text").mapInArrow(
        _round_trip,
        f"doc_id {ids}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
    )


def _packets(batches):
    for batch in batches:
        out = []
        for key, data in zip(batch.column("media_id").to_pylist(), batch.column("media").to_pylist()):
            media = parse(data or b"")
            out += [(key, i, p.track, p.timestamp_ns, p.cluster, p.start, p.size, p.key, p.lacing) for i, p in enumerate(media.packets)]
        types = [batch.schema.field("media_id").type, pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
        names = ["media_id", "packet", "track", "timestamp_ns", "cluster", "start", "size", "key_frame", "lacing"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * len(types), types)], names)


def packet_table(media: DataFrame) -> DataFrame:
    """media: media_id, media (binary) -> one row for each packet with its byte range."""
    ids = media.schema["media_id"].dataType.simpleString()
    return lean(media).select("media_id", "media").mapInArrow(
        _packets, f"media_id {ids}, packet int, track long, timestamp_ns long, cluster int, start long, size long, key_frame boolean, lacing string"
    )
