"""Matroska media columns: a writer for 8-bit PCM tracks, and a parser to packet tables.

The parser walks EBML elements with variable-length ids and sizes (also unknown sizes), reads tracks, clusters, SimpleBlocks and
BlockGroups with every kind of lacing, and cues, and gives a packet for each frame: track, timestamp, lace, byte range, key flag.

Everything is row-local: media columns are mapped in Arrow batches, nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element ids of the Matroska specification.
EBML, SEGMENT, SEEK_HEAD, INFO, TRACKS, CUES, CLUSTER = 0x1A45DFA3, 0x18538067, 0x114D9B74, 0x1549A966, 0x1654AE6B, 0x1C53BB6B, 0x1F43B675
EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE, DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
TIMESTAMP_SCALE, MUXING_APP, WRITING_APP, DURATION = 0x2AD7B1, 0x4D80, 0x5741, 0x4489
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID, AUDIO, SAMPLING, CHANNELS, BIT_DEPTH = 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0xE7, 0xA3, 0xA0, 0xA1
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 2, 4, 6
_TOP = {SEEK_HEAD, INFO, TRACKS, CUES, CLUSTER}

RATE, FRAME, LACED, CLUSTER_BYTES = 8000, 256, 8, 1 << 15


def vint(value: int, width: int = 0) -> bytes:
    """A size as a variable-length integer, of the least width unless one is given."""
    width = width or next(w for w in range(1, 9) if value < (1 << 7 * w) - 1)
    return (value | 1 << 7 * width).to_bytes(width, "big")


def element(number: int, data: bytes) -> bytes:
    return number.to_bytes((number.bit_length() + 7) // 8, "big") + vint(len(data)) + data


def number(x: int) -> bytes:
    return x.to_bytes(max(1, (x.bit_length() + 7) // 8), "big")


def lace(frames: list[bytes], kind: int) -> bytes:
    """Lace header and frames of a block."""
    if kind == NO_LACING:
        return frames[0]
    sizes = [len(f) for f in frames]
    head = bytes([len(frames) - 1])
    if kind == XIPH:
        head += b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
    elif kind == EBML_LACING and len(sizes) > 1:
        head += vint(sizes[0])
        for before, s in zip(sizes, sizes[1:-1], strict=False):
            step = s - before
            width = next(w for w in range(1, 9) if abs(step) < (1 << (7 * w - 1)) - 1)
            head += vint(step + (1 << (7 * width - 1)) - 1, width)
    return head + b"".join(frames)


def write(payload: bytes, frame: int = FRAME, laced: int = LACED, cluster_bytes: int = CLUSTER_BYTES) -> bytes:
    """A Matroska file with one 8-bit PCM track of the payload, cut into frames. Timestamps are milliseconds of 8000 samples a second."""
    info = element(TIMESTAMP_SCALE, number(1_000_000)) + element(MUXING_APP, b"lodeline") + element(WRITING_APP, b"lodeline")
    audio = element(SAMPLING, np.array(RATE, ">f8").tobytes()) + element(CHANNELS, b"\x01") + element(BIT_DEPTH, b"\x08")
    track = element(TRACK_NUMBER, b"\x01") + element(TRACK_UID, b"\x01") + element(TRACK_TYPE, b"\x02") + element(FLAG_LACING, b"\x01") + element(CODEC_ID, b"A_PCM/INT/LIT") + element(AUDIO, audio)
    head = element(EBML, element(EBML_VERSION, b"\x01") + element(EBML_READ_VERSION, b"\x01") + element(EBML_MAX_ID, b"\x04") + element(EBML_MAX_SIZE, b"\x08") + element(DOC_TYPE, b"matroska") + element(DOC_VERSION, b"\x04") + element(DOC_READ_VERSION, b"\x02"))
    body, cues = element(INFO, info) + element(TRACKS, element(TRACK_ENTRY, track)), b""
    parts, at = [body], len(body)
    for start in range(0, len(payload), cluster_bytes):
        base = start * 1000 // RATE
        blocks = [element(TIMESTAMP, number(base))]
        stop = min(start + cluster_bytes, len(payload))
        for first in range(start, stop, frame * laced):
            frames = [payload[i : min(i + frame, stop)] for i in range(first, min(first + frame * laced, stop), frame)]
            even = len(frames[-1]) == frame
            kind = NO_LACING if len(frames) == 1 else FIXED if even else EBML_LACING if len(frames) > 2 else XIPH
            relative = first * 1000 // RATE - base
            blocks.append(element(SIMPLE_BLOCK, b"\x81" + relative.to_bytes(2, "big", signed=True) + bytes([0x80 | kind]) + lace(frames, kind)))
        cluster = element(CLUSTER, b"".join(blocks))
        cues += element(CUE_POINT, element(CUE_TIME, number(base)) + element(CUE_TRACK_POSITIONS, element(CUE_TRACK, b"\x01") + element(CUE_CLUSTER_POSITION, number(at))))
        parts.append(cluster)
        at += len(cluster)
    parts.append(element(CUES, cues) if cues else b"")
    return head + element(SEGMENT, b"".join(parts))


@dataclass
class Media:
    """What a file holds; packets: (track, timestamp in timestamp units, lace, offset, length, key)."""

    tracks: dict[int, str] = field(default_factory=dict)
    packets: list[tuple[int, int, int, int, int, bool]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)  # position in the segment
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # time, track, cluster position
    scale: int = 1_000_000


def read_vint(data: bytes, at: int, marked: bool = False) -> tuple[int, int]:
    """Value and width; marked: with the marker bit, as ids are. All ones in a size: -1, unknown."""
    width = 9 - data[at].bit_length() if at < len(data) else 9
    if width > 8:
        raise ValueError(f"no variable-length integer at {at}")
    if at + width > len(data):
        raise ValueError(f"the variable-length integer at {at} exceeds the file")
    value = int.from_bytes(data[at : at + width], "big")
    if marked:
        return value, width
    value &= (1 << 7 * width) - 1
    return (-1 if value == (1 << 7 * width) - 1 else value), width


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """Id, start and end of the data of each element; one of unknown size reaches to the end."""
    while at < end:
        name, width = read_vint(data, at, True)
        size, more = read_vint(data, at + width)
        start = at + width + more
        stop = end if size < 0 else start + size
        if stop > end:
            raise ValueError(f"element {name:#x} at {at} exceeds its parent")
        yield name, start, stop
        at = stop


def frames(data: bytes, start: int, stop: int, kind: int) -> list[tuple[int, int]]:
    """Start and length of each frame of a block."""
    if kind == NO_LACING:
        return [(start, stop - start)]
    if start >= stop:
        raise ValueError(f"no lace sizes in the block at {start}")
    n, at = data[start] + 1, start + 1
    sizes: list[int] = []
    if kind == FIXED:
        sizes = [(stop - at) // n] * (n - 1)
    elif kind == XIPH:
        for _ in range(n - 1):
            size = 0
            while at < stop and data[at] == 255:
                size, at = size + 255, at + 1
            if at >= stop:
                raise ValueError(f"lace sizes exceed the block at {start}")
            sizes.append(size + data[at])
            at += 1
    elif n > 1:
        size, width = read_vint(data, at)
        sizes, at = [size], at + width
        for _ in range(n - 2):
            step, width = read_vint(data, at)
            step = (1 << 7 * width) - 1 if step < 0 else step
            sizes.append(sizes[-1] + step - ((1 << (7 * width - 1)) - 1))
            at += width
    sizes.append(stop - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError(f"lace sizes exceed the block at {start}")
    starts = np.cumsum([at, *sizes[:-1]]).tolist()
    return list(zip(starts, sizes, strict=True))


def _block(media: Media, data: bytes, start: int, stop: int, base: int, simple: bool) -> None:
    track, width = read_vint(data, start)
    at = start + width
    if at + 3 > stop:
        raise ValueError(f"no block header at {start}")
    time, flags = base + int.from_bytes(data[at : at + 2], "big", signed=True), data[at + 2]
    for i, (first, length) in enumerate(frames(data, at + 3, stop, flags & 6)):
        media.packets.append((track, time, i, first, length, bool(flags & 0x80) if simple else True))


def _cluster(media: Media, data: bytes, start: int, stop: int) -> int:
    """Parse a cluster; gives its end, which for one of unknown size is where the next top element begins."""
    base, at = 0, start
    while at < stop:
        name, width = read_vint(data, at, True)
        if name in _TOP:
            return at
        size, more = read_vint(data, at + width)
        first = at + width + more
        last = first + size
        if size < 0 or last > stop:
            raise ValueError(f"element {name:#x} at {at} exceeds its cluster")
        if name == TIMESTAMP:
            base = int.from_bytes(data[first:last], "big")
        elif name == SIMPLE_BLOCK:
            _block(media, data, first, last, base, True)
        elif name == BLOCK_GROUP:
            for inner, a, b in elements(data, first, last):
                if inner == BLOCK:
                    _block(media, data, a, b, base, False)
        at = last
    return at


def parse(data: bytes) -> Media:
    """Tracks, packets, clusters and cues of a file. Damaged structure raises ValueError."""
    media, at = Media(), 0
    value = lambda a, b: int.from_bytes(data[a:b], "big")
    for name, start, stop in elements(data, 0, len(data)):
        if name != SEGMENT:
            continue
        at = start
        while at < stop:
            inner, width = read_vint(data, at, True)
            size, more = read_vint(data, at + width)
            a = at + width + more
            b = stop if size < 0 else a + size
            if b > stop:
                raise ValueError(f"element {inner:#x} at {at} exceeds the segment")
            if inner == CLUSTER:
                media.clusters.append(at - start)
                b = _cluster(media, data, a, b)
            elif inner == INFO:
                media.scale = next((value(c, d) for x, c, d in elements(data, a, b) if x == TIMESTAMP_SCALE), media.scale)
            elif inner == TRACKS:
                for _, c, d in elements(data, a, b):
                    entry = {x: (e, f) for x, e, f in elements(data, c, d)}
                    if TRACK_NUMBER in entry:
                        media.tracks[value(*entry[TRACK_NUMBER])] = data[slice(*entry.get(CODEC_ID, (0, 0)))].decode("ascii", "replace")
            elif inner == CUES:
                for _, c, d in elements(data, a, b):
                    time, where = 0, []
                    for x, e, f in elements(data, c, d):
                        if x == CUE_TIME:
                            time = value(e, f)
                        elif x == CUE_TRACK_POSITIONS:
                            own = {y: value(g, h) for y, g, h in elements(data, e, f)}
                            where.append((own.get(CUE_TRACK, 0), own.get(CUE_CLUSTER_POSITION, 0)))
                    media.cues += [(time, track, position) for track, position in where]
            at = b
    return media


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes (of the text in UTF-8) and media: the text, padded with bytes 0 to a positive multiple of 64, as a Matroska file.

    A null text is empty. Null ids and repeated rows are kept; other columns are not read.
    """

    def store(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                texts = [(x or "").encode() for x in part.column("text").to_pylist()]
                media = [write(t + b"\0" * (-len(t) % 64 or 64 * (not t))) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=[id_col, "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(store, f"`{id_col}` long, n_bytes long, media binary")


def packet_table(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """A row for each packet of each file: id, track, timestamp_ns, lace, byte_start, byte_length, key. A null file has none."""

    def rows(batches):
        for batch in batches:
            for ident, data in zip(batch.column("id"), batch.column("media"), strict=True):
                if not data.is_valid:
                    continue
                found = parse(data.as_py())
                columns = list(zip(*((t, time * found.scale, i, a, n, key) for t, time, i, a, n, key in found.packets), strict=True)) or [()] * 6
                types = [pa.int64()] * 5 + [pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array([ident.as_py()] * len(columns[0]), pa.int64()), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["id", "track", "timestamp_ns", "lace", "byte_start", "byte_length", "key"])

    out = media.select(F.col(id_col).alias("id"), F.col(media_col).alias("media")).mapInArrow(rows, "id long, track long, timestamp_ns long, lace long, byte_start long, byte_length long, key boolean")
    return out.withColumnRenamed("id", id_col)


def media_features(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """For each row of media_column: n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature.

    The payload is read back from the packets. feature: tracks, packets, clusters, cues that point at a cluster, milliseconds, a checksum
    of the packet table, and mean and spread of the samples.
    """

    def read(batches):
        for batch in batches:
            rows = []
            for raw in batch.column("media"):
                data = raw.as_py()
                m = parse(data)
                payload = b"".join(data[a : a + n] for _, _, _, a, n, _ in m.packets)
                samples = np.frombuffer(payload, np.uint8)
                aimed = len({p for _, _, p in m.cues} & set(m.clusters))
                table = zlib.crc32(np.array([p[:5] for p in m.packets], "<i8").tobytes())
                feature = f"tracks={len(m.tracks)};packets={len(m.packets)};clusters={len(m.clusters)};cues={aimed};ms={len(payload) * 1000 // RATE};table={table:08x};mean={samples.mean():.3f};spread={samples.std():.3f}"
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(id_col), batch.column("n_bytes"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.select(id_col, "n_bytes", "media").mapInArrow(read, f"`{id_col}` long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
