"""Media columns: Matroska files as packet tables.

`scan` walks the variable-length elements of a file and yields every frame of every block,
laced or not, with its track, timestamp and byte range; `packets` and `cues` do so for a
column.  `write` muxes the frames of one audio track.  `text_media` stores texts as 8-bit
samples this way and reads them back through the packet table: cue by cue, each cluster's
packets by their times.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from blockloom.llm import textvec as V

# Element ids of the format.
EBML, SEGMENT, SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x114D9B74, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TIMESTAMP_SCALE, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE = 0x2AD7B1, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
TRACK_ENTRY, TRACK_NUMBER, TRACK_TYPE, CODEC, DEFAULT_DURATION = 0xAE, 0xD7, 0x83, 0x86, 0x23E383
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
# Lacing bits of a block's flags.
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 2, 4, 6
#: Elements that hold elements.
MASTERS = {SEGMENT, CLUSTER, BLOCK_GROUP, TRACKS, TRACK_ENTRY, CUES, CUE_POINT, CUE_POSITIONS, INFO}
TOP = {SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES, SEGMENT, EBML}

FRAME = 576
RATE = 8000
FRAMES_PER_BLOCK = 8
BLOCKS_PER_CLUSTER = 48
PAD = b"\xff"


def vint(value: int, width: int = 0) -> bytes:
    """A size or number as a variable-length integer, as short as it can be or of a given width."""
    width = width or next(n for n in range(1, 9) if value < (1 << 7 * n) - 1)
    return (value | 1 << 7 * width).to_bytes(width, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def number(ident: int, value: int, width: int = 0) -> bytes:
    return element(ident, value.to_bytes(width or max(1, (value.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], kind: int) -> bytes:
    """The lacing header of several frames and then the frames."""
    sizes = [len(f) for f in frames]
    head = bytes([len(frames) - 1])
    if kind == XIPH:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif kind == EBML_LACING:
        head += vint(sizes[0])
        for a, b in zip(sizes, sizes[1:-1]):
            d = b - a
            width = next(n for n in range(1, 9) if abs(d) < (1 << 7 * n - 1) - 1)
            head += vint(d + (1 << 7 * width - 1) - 1, width)
    return head + b"".join(frames)


_HEAD = element(EBML, number(0x4286, 1) + number(0x42F7, 1) + number(0x42F2, 4) + number(0x42F3, 8) + element(0x4282, b"matroska") + number(0x4287, 4) + number(0x4285, 2))
_AUDIO = element(TRACKS, element(TRACK_ENTRY, number(TRACK_NUMBER, 1) + number(0x73C5, 1) + number(TRACK_TYPE, 2) + number(0x9C, 1) + number(DEFAULT_DURATION, FRAME * 10**9 // RATE) + element(CODEC, b"A_PCM/INT/LIT") + element(0xE1, element(0xB5, struct.pack(">d", RATE)) + number(0x9F, 1) + number(0x6264, 8))))


def write(frames: list[bytes]) -> bytes:
    """A file of one 8-bit mono track; frame k starts at k * 72 ms.  Equal frames, equal file."""
    step = FRAME * 1000 // RATE
    info = element(INFO, number(TIMESTAMP_SCALE, 10**6) + element(0x4489, struct.pack(">d", len(frames) * step)) + element(0x4D80, b"blockloom") + element(0x5741, b"blockloom"))
    clusters, points, place = [], [], len(info) + len(_AUDIO)
    per_cluster = FRAMES_PER_BLOCK * BLOCKS_PER_CLUSTER
    for c in range(0, len(frames), per_cluster):
        body = [number(TIMESTAMP, c * step)]
        for n, b in enumerate(range(c, min(c + per_cluster, len(frames)), FRAMES_PER_BLOCK)):
            group = frames[b : b + FRAMES_PER_BLOCK]
            kind = (FIXED, EBML_LACING, XIPH)[n % 3] if len(group) > 1 else NO_LACING
            block = b"\x81" + struct.pack(">h", (b - c) * step) + bytes([0x80 | kind]) + (lace(group, kind) if kind else group[0])
            body.append(element(SIMPLE_BLOCK, block))
        points.append(element(CUE_POINT, number(CUE_TIME, c * step) + element(CUE_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, place, 8))))
        clusters.append(element(CLUSTER, b"".join(body)))
        place += len(clusters[-1])
    return _HEAD + element(SEGMENT, b"".join([info, _AUDIO, *clusters, element(CUES, b"".join(points))]))


@dataclass(slots=True)
class Packet:
    track: int
    timestamp_ns: int
    offset: int
    size: int
    keyframe: bool
    cluster: int
    lace: int


class Damaged(ValueError):
    """The bytes are not a readable file from here on."""


def read_vint(data: bytes, at: int, marker: bool) -> tuple[int, int]:
    """(value, next place); marker: keep the length marker, as ids do.  All ones give -1."""
    if at >= len(data) or not data[at]:
        raise Damaged(f"no variable-length integer at {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise Damaged(f"the file ends within an integer at {at}")
    value = int.from_bytes(data[at : at + width], "big")
    if not marker:
        value &= (1 << 7 * width) - 1
        if value == (1 << 7 * width) - 1:
            value = -1
    return value, at + width


def frame_sizes(data: bytes, at: int, end: int, kind: int) -> tuple[int, list[int]]:
    """Where a block's frames begin, and their sizes."""
    if kind == NO_LACING:
        return at, [end - at]
    if at >= end:
        raise Damaged(f"a laced block without a count at {at}")
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if kind == FIXED:
        if (end - at) % n:
            raise Damaged(f"frames of unequal size in fixed lacing at {at}")
        return at, [(end - at) // n] * n
    for k in range(n - 1):
        if kind == XIPH:
            size = 0
            while True:
                if at >= end:
                    raise Damaged(f"the block ends within its lacing at {at}")
                size, at = size + data[at], at + 1
                if data[at - 1] < 255:
                    break
        else:
            value, after = read_vint(data, at, False)
            if value < 0:
                value = (1 << 7 * (after - at)) - 1
            size = value if not k else sizes[-1] + value - ((1 << 7 * (after - at) - 1) - 1)
            at = after
        sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise Damaged(f"frames longer than their block at {at}")
    return at, sizes


def unsigned(data: bytes, at: int, end: int) -> int:
    if end - at > 8:
        raise Damaged(f"a number of more than 8 bytes at {at}")
    return int.from_bytes(data[at:end], "big")


def within(value: int, bits: int, what: str, at: int) -> int:
    """value, if a signed integer of so many bits holds it."""
    if not -(1 << bits - 1) <= value < 1 << bits - 1:
        raise Damaged(f"{what} beyond {bits} bits at {at}")
    return value


def scan(data: bytes) -> Iterator[tuple]:
    """("track", number, type, codec), ("packet", Packet) and ("cue", time_ns, track, place), in file order.

    An element of unknown size ends where what holds it ends, a cluster also before the next
    element of its own level, a segment before the next segment or file head.
    """
    scale, cluster, cluster_at, segment = 10**6, 0, -1, 0
    stack: list[list] = []  # [id, end, state, whether its size is unknown]
    durations: dict[int, int] = {}  # of each track that tells it, ns a frame
    at, n = 0, len(data)
    while at < n or stack:
        while stack and at >= stack[-1][1]:
            ident, _, got, _ = stack.pop()
            if ident == TRACK_ENTRY:
                durations[got.get(TRACK_NUMBER, 0)] = got.get(DEFAULT_DURATION, 0)
                yield "track", got.get(TRACK_NUMBER, 0), got.get(TRACK_TYPE, 0), got.get(CODEC, "")
            elif ident == CUE_POSITIONS:
                point = stack[-1][2] if stack else {}
                yield "cue", within(point.get(CUE_TIME, 0) * scale, 64, "a cue's time", at), within(got.get(CUE_TRACK, 0), 32, "a track", at), within(got.get(CUE_CLUSTER, 0) + segment, 64, "a cue's place", at)
            elif ident == BLOCK_GROUP and BLOCK in got:
                yield from (("packet", p) for p in _block(data, *got[BLOCK], cluster, cluster_at, scale, durations, REFERENCE not in got))
        if at >= n:
            if stack:
                raise Damaged(f"the file ends within an element at {at}")
            break
        begin = at
        ident, at = read_vint(data, at, True)
        size, at = read_vint(data, at, False)
        if ident in TOP:
            ends = (CLUSTER, SEGMENT) if ident in (SEGMENT, EBML) else (CLUSTER,)
            while stack and stack[-1][3] and stack[-1][0] in ends:
                stack.pop()
        limit = stack[-1][1] if stack else n
        if size < 0 and ident not in MASTERS:
            raise Damaged(f"an element without a size at {begin}")
        end = limit if size < 0 else at + size
        if end > limit:
            raise Damaged(f"an element at {begin} is longer than what holds it")
        if ident in MASTERS:
            stack.append([ident, end, {}, size < 0])
            if ident == SEGMENT:
                segment = at
            elif ident == CLUSTER:
                cluster_at, cluster = begin, 0
            continue
        got = stack[-1][2] if stack else {}
        if ident == TIMESTAMP_SCALE:
            scale = unsigned(data, at, end)
        elif ident == TIMESTAMP:
            cluster = unsigned(data, at, end)
        elif ident == SIMPLE_BLOCK:
            yield from (("packet", p) for p in _block(data, at, end, cluster, cluster_at, scale, durations, None))
        elif ident == BLOCK:
            got[ident] = (at, end)
        elif ident == CODEC:
            got[ident] = data[at:end].decode("ascii", "replace")
        elif ident in (TRACK_NUMBER, TRACK_TYPE, CUE_TIME, CUE_TRACK, CUE_CLUSTER, REFERENCE, DEFAULT_DURATION):
            got[ident] = unsigned(data, at, end)
        at = end


def _block(data: bytes, at: int, end: int, cluster: int, cluster_at: int, scale: int, durations: dict[int, int], key: bool | None) -> Iterator[Packet]:
    track, at = read_vint(data, at, False)
    if at + 3 > end:
        raise Damaged(f"the block ends within its head at {at}")
    within(track, 32, "a track", at)
    relative, flags = struct.unpack_from(">hB", data, at)
    at, sizes = frame_sizes(data, at + 3, end, flags & 6)
    for k, size in enumerate(sizes):
        time = within((cluster + relative) * scale + k * durations.get(track, 0), 64, "a timestamp", at)
        yield Packet(track, time, at, size, bool(flags & 0x80) if key is None else key, cluster_at, k)
        at += size


def packets(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """One row per frame: id, packet, track, timestamp_ns, lace, offset, size, keyframe, cluster, error.

    A laced frame's time is its block's and as many of its track's default durations as frames
    stand before it; where the track tells none, it is the block's.  Null media give no row.  Damaged media give the packets before the damage and then one
    row whose packet is null and whose error says where it is.  Other columns are ignored.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for ident, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if media is None:
                    continue
                n = 0
                try:
                    for what, *p in scan(media):
                        if what == "packet":
                            p = p[0]
                            rows.append((ident, n, p.track, p.timestamp_ns, p.lace, p.offset, p.size, p.keyframe, p.cluster, None))
                            n += 1
                except Damaged as e:
                    rows.append((ident, *[None] * 8, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else [()] * 10, schema)], schema=schema)

    kind = df.schema[id_col].dataType.simpleString()
    ddl = f"id {kind}, packet int, track int, timestamp_ns long, lace int, offset long, size long, keyframe boolean, cluster long, error string"
    from pyspark.sql.pandas.types import to_arrow_schema

    out = df.select(df[id_col].alias("id"), df[media_col])
    schema = to_arrow_schema(out.sparkSession.createDataFrame([], ddl).schema)
    return out.mapInArrow(run, ddl)


def cues(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """One row per cue: id, time_ns, track, cluster (its byte place), error.

    Null media give none; damaged media give the cues before the damage and then one row with
    nothing but the error.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for ident, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    for what, *x in scan(media or b""):
                        if what == "cue":
                            rows.append((ident, *x, None))
                except Damaged as e:
                    rows.append((ident, None, None, None, str(e)))
            cols = list(zip(*rows)) if rows else [()] * 5
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, [batch.schema.field(0).type, pa.int64(), pa.int32(), pa.int64(), pa.string()])], ["id", "time_ns", "track", "cluster", "error"])

    return df.select(df[id_col].alias("id"), df[media_col]).mapInArrow(run, f"id {df.schema[id_col].dataType.simpleString()}, time_ns long, track int, cluster long, error string")


#: Columns of a packet table.
PACKETS = ("track", "timestamp_ns", "offset", "size", "cluster", "lace")


def packet_table(media: bytes) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """(a column each of PACKETS in file order; time and cluster of the cues, by time) of a whole file."""
    rows, points = [], []
    for what, *x in scan(media):
        if what == "packet":
            p = x[0]
            rows.append((p.track, p.timestamp_ns, p.offset, p.size, p.cluster, p.lace))
        elif what == "cue":
            points.append((x[0], x[2]))
    table = np.array(rows, np.int64).reshape(-1, len(PACKETS))
    return dict(zip(PACKETS, table.T)), np.array(sorted(points), np.int64).reshape(-1, 2)


def read_back(media: bytes, table: dict[str, np.ndarray], points: np.ndarray) -> np.ndarray:
    """The samples: the clusters in the order of their cues, the packets of a cluster by time."""
    turn = np.full(len(table["cluster"]), -1)
    by_place = np.argsort(points[:, 1], kind="stable")
    at = np.searchsorted(points[by_place, 1], table["cluster"])
    cued = at < len(points)
    cued[cued] &= points[by_place[at[cued]], 1] == table["cluster"][cued]
    turn[cued] = by_place[at[cued]]
    if (turn < 0).any():
        raise Damaged("a cluster without a cue")
    order = np.lexsort((table["lace"], table["timestamp_ns"], turn))
    return np.frombuffer(media, np.uint8)[V.ragged(table["offset"][order], table["size"][order])]


def payload(text: bytes) -> bytes:
    """The text's bytes, filled with 255 up to a positive multiple of a frame."""
    return text + PAD * (max(1, -(-len(text) // FRAME)) * FRAME - len(text))


def feature(samples: np.ndarray, table: dict[str, np.ndarray], points: np.ndarray) -> str:
    """Packets, cues, mean, deviation, crossings of the mean, and the energy of 8 parts of the track."""
    x = samples.astype(np.float64)
    centred = x - x.mean()
    crossings = int(np.count_nonzero(np.signbit(centred[1:]) != np.signbit(centred[:-1])))
    energy = [float((part * part).mean()) if len(part) else 0.0 for part in np.array_split(centred, 8)]
    return f"{len(table['size'])}:{len(points)}:{x.mean():.4f}:{x.std():.4f}:{crossings}:" + ",".join(f"{e:.2f}" for e in energy)


def text_media(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """Each whole text stored as a file and read back by its cues and packets.

    doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    feature, packets, and with keep_media the file as `media`.  Null and empty texts give one
    frame of filling; equal texts give equal values; repeated rows are repeated.
    """

    @V.tidy
    def run(batches):
        for batch in batches:
            for i, j, data, offsets in V.parts(batch.column(1)):
                rows, raw, at = [], data.tobytes(), offsets.tolist()
                for a, b in zip(at, at[1:]):
                    body = payload(raw[a:b])
                    media = write([body[k : k + FRAME] for k in range(0, len(body), FRAME)])
                    table, points = packet_table(media)
                    samples = read_back(media, table, points)
                    back = samples.tobytes()
                    rows.append((b - a, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples, table, points), len(table["size"]), *[media] * keep_media))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.binary()]
                yield pa.record_batch([batch.column(0)[i:j], *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names)

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "packets", *["media"] * keep_media]
    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, packets int" + ", media binary" * keep_media)
