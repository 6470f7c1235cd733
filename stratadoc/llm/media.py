r"""Media columns: baseline JPEG, read down to DC-only luminance thumbnails in numpy.

``parse`` reads the markers of any baseline JPEG (several components, sampling
factors, restart intervals), ``thumbnails`` decodes the Huffman-coded scans and
keeps of each 8x8 block of the luminance its DC coefficient, which is the
block's mean. All restart intervals of all images with the same tables are
decoded in step, one lane each, so numpy does the work of the bit loop.

The unit of storage is the DC coefficient: with a DC quantiser of 8 and no AC
coefficients a coefficient is one 8-bit sample, stored without loss as a flat
8x8 block. ``encode`` writes payloads so, 24 blocks a row and one restart
interval a row; a payload beyond one image's height goes on in further images.

Defined results: null texts count as empty and become one unit of padding;
equal texts give equal values; repeated rows each get their row; an empty table
gives an empty result; columns beside ``doc_id`` and ``text`` are ignored. Bytes
that are not a baseline JPEG raise ValueError.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stratadoc.llm._shared import bound_batches, chunks, table, task

#: Payloads are padded with 255 to a multiple of UNIT; a thumbnail is SIDE samples wide.
UNIT, SIDE = 576, 24
#: Units in one image: its height in pixels must fit in 16 bits.
MOST_UNITS = 65535 // (8 * SIDE)
#: Characters of text encoded and decoded together.
CHUNK = 1 << 20


def _table(cls: int, number: int, by_length: dict[int, list[int]]) -> bytes:
    counts = bytes(len(by_length.get(n, [])) for n in range(1, 17))
    symbols = bytes(s for n in range(1, 17) for s in by_length.get(n, []))
    return b"\xff\xc4" + struct.pack(">HB", 19 + len(symbols), cls << 4 | number) + counts + symbols


# Twelve DC categories in codes of four bits; the end of a block in one bit.
_DHT = _table(0, 0, {4: list(range(12))}) + _table(1, 0, {1: [0]})
_DQT = b"\xff\xdb" + struct.pack(">HB", 67, 0) + bytes([8]) + bytes([1]) * 63


def header(height: int) -> bytes:
    """All markers up to the scan of an image of SIDE blocks a row."""
    frame = b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, height, 8 * SIDE, 1) + bytes([1, 0x11, 0])
    restart = b"\xff\xdd" + struct.pack(">HH", 4, SIDE)
    return b"\xff\xd8" + _DQT + frame + _DHT + restart + b"\xff\xda" + struct.pack(">HB", 8, 1) + bytes([1, 0, 0, 63, 0])


_CATEGORY = np.array([int(n).bit_length() for n in range(512)], np.int64)


def encode(payloads: list[bytes]) -> list[list[bytes]]:
    """The images of each payload; lengths are positive multiples of UNIT."""
    samples = np.frombuffer(b"".join(payloads), np.uint8).astype(np.int64).reshape(-1, SIDE) - 128
    diff = samples.copy()
    diff[:, 1:] -= samples[:, :-1]
    cat = _CATEGORY[np.abs(diff)]
    code = ((cat << cat) + np.where(diff < 0, diff + (1 << cat) - 1, diff)) << 1  # category, its bits, end of block
    length = cat + 5
    ends = np.cumsum(length, axis=1)
    row_bytes = (ends[:, -1] + 7) >> 3
    row_at = np.concatenate([[0], np.cumsum(row_bytes)])
    at = (row_at[:-1, None] * 8 + ends - length).ravel()
    first = at >> 3
    value = code.ravel() << (24 - length.ravel() - (at & 7))
    new = np.flatnonzero(np.diff(first, prepend=-1))
    sums, where = np.add.reduceat(value, new), first[new]
    out = np.zeros(int(row_at[-1]) + 3, np.int64)
    for k in range(3):
        out[where + k] += (sums >> (16 - 8 * k)) & 255
    out = out[:-3]
    out[row_at[1:] - 1] += (1 << (row_bytes * 8 - ends[:, -1])) - 1  # ones fill the last byte
    # Every 255 is followed by a zero, every row but an image's last by a restart marker.
    rows = np.array([len(p) // SIDE for p in payloads])
    images, row = [], 0
    for n in rows:
        images.append([(s, min(s + MOST_UNITS * SIDE, row + n)) for s in range(row, row + n, MOST_UNITS * SIDE)])
        row += int(n)
    in_image = np.concatenate([np.arange(b - a) for each in images for a, b in each])
    last = np.array([b - 1 for each in images for _, b in each])
    stuffed = (out == 255).astype(np.int64)
    place = np.arange(len(out)) + np.cumsum(stuffed) - stuffed + 2 * np.repeat(np.arange(len(row_bytes)), row_bytes)
    whole = np.zeros(len(out) + int(stuffed.sum()) + 2 * len(row_bytes), np.uint8)
    whole[place] = out
    row_end = place[row_at[1:] - 1] + 1 + stuffed[row_at[1:] - 1]
    whole[row_end] = 255
    whole[row_end + 1] = 0xD0 + (in_image & 7)
    whole[row_end[last] + 1] = 0xD9
    data = whole.tobytes()
    begin = np.concatenate([[0], row_end + 2])
    return [[header((b - a) * 8) + data[begin[a] : begin[b]] for a, b in each] for each in images]


#: A marker that ends a scan: neither a stuffed byte nor a restart.
_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7]")


@dataclass
class Image:
    """What the markers of a baseline JPEG say, and its scan's bytes."""

    height: int = 0
    width: int = 0
    #: (id, horizontal factor, vertical factor, quantiser), then for each the numbers of its Huffman tables.
    components: list[tuple] = field(default_factory=list)
    tables: dict[int, tuple] = field(default_factory=dict)
    coded: dict[int, tuple[int, int]] = field(default_factory=dict)
    dc_quantisers: dict[int, int] = field(default_factory=dict)
    restart: int = 0
    scan: bytes = b""

    @property
    def grid(self) -> tuple[int, int, int, int]:
        """Blocks of the first component: MCUs down and across, its blocks down and across in one."""
        h, v = max(c[1] for c in self.components), max(c[2] for c in self.components)
        if len(self.components) == 1:
            return -(-self.height // 8), -(-self.width // 8), 1, 1
        return -(-self.height // (8 * v)), -(-self.width // (8 * h)), self.components[0][2], self.components[0][1]


def parse(data: bytes) -> tuple[Image, int]:
    """The image that ``data`` begins with, and where it ends."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no start of image")
    image, at = Image(), 2
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            raise ValueError("marker expected")
        kind = data[at + 1]
        if kind == 0xFF:
            at += 1
            continue
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if kind == 0xDB:
            while body:
                wide = body[0] >> 4
                image.dc_quantisers[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                body = body[1 + 64 * (1 + wide) :]
        elif kind == 0xC4:
            while body:
                n = sum(body[1:17])
                image.tables[body[0]] = (bytes(body[1:17]), bytes(body[17 : 17 + n]))
                body = body[17 + n :]
        elif kind == 0xC0:
            image.height, image.width = struct.unpack(">HH", body[1:5])
            image.components = [(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * body[5], 3)]
        elif 0xC1 <= kind <= 0xCF and kind not in (0xC8, 0xCC):
            raise ValueError("not baseline")
        elif kind == 0xDD:
            image.restart = int.from_bytes(body, "big")
        elif kind == 0xDA:
            image.coded = {body[i]: (body[i + 1] >> 4, body[i + 1] & 15) for i in range(1, 1 + 2 * body[0], 2)}
            break
    if not image.components or len(image.coded) != len(image.components):
        raise ValueError("one scan of all components expected")
    end = _MARKER.search(data, at)
    if not end:
        raise ValueError("scan without end")
    start, at = at, end.start()
    image.scan = data[start:at]
    if data[at + 1] != 0xD9:
        raise ValueError("end of image expected")
    return image, at + 2


def _lookup(lengths: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Length and symbol of the code that each 16 bits begin with."""
    length, symbol = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    code, k = 0, 0
    for n, count in enumerate(lengths, 1):
        for _ in range(count):
            span = slice(code << (16 - n), (code + 1) << (16 - n))
            length[span], symbol[span] = n, symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return length, symbol


def _intervals(scan: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The scan without stuffing and markers, where the intervals begin in it, and where the markers were."""
    ff = np.flatnonzero(scan[:-1] == 255)
    after = scan[ff + 1]
    drop = np.ones(len(scan), bool)
    drop[ff[after == 0] + 1] = False
    marks = ff[(after >= 0xD0) & (after <= 0xD9)]
    drop[marks] = False
    drop[marks + 1] = False
    kept = np.cumsum(drop)
    return scan[drop], np.concatenate([[0], kept[marks]]), marks


def _decode(images: list[Image]) -> list[np.ndarray]:
    """DC values of the first component of images with the same tables and layout."""
    like = images[0]
    luts = {k: _lookup(*v) for k, v in like.tables.items()}
    # One buffer of all scans, an end mark after each.
    scans = np.frombuffer(b"".join(i.scan + b"\xff\xd9" for i in images), np.uint8)
    data, begins, _ = _intervals(scans)
    begins = begins[:-1]
    mcus = []
    for i in images:
        down, across, *_ = i.grid
        n, step = down * across, i.restart or down * across
        mcus += [min(step, n - k) for k in range(0, n, step)]
    mcus = np.array(mcus, np.int64)
    if len(mcus) != len(begins):
        raise ValueError("restart intervals are missing")
    wide = np.concatenate([data, np.full(8, 255, np.uint8)]).astype(np.int64)
    words = wide[:-3] << 24 | wide[1:-2] << 16 | wide[2:-1] << 8 | wide[3:]
    top = len(words) - 1
    pos = begins * 8

    def peek(p, n):
        return (words[np.minimum(p >> 3, top)] >> (32 - n - (p & 7))) & ((1 << n) - 1)

    def extra(p, s):
        bits = peek(p, 16) >> (16 - s)
        return np.where(bits < (1 << s) >> 1, bits - (1 << s) + 1, bits)

    layout = [(0, 0)] if len(like.components) == 1 else [(c, b) for c, comp in enumerate(like.components) for b in range(comp[1] * comp[2])]
    first = sum(c == 0 for c, _ in layout)
    most = int(mcus.max())
    dc = np.zeros((len(mcus), most, first), np.int64)
    pred = np.zeros((len(mcus), len(like.components)), np.int64)
    even = bool((mcus == most).all())
    for m in range(most):
        lanes = slice(None) if even else np.flatnonzero(mcus > m)
        for c, b in layout:
            dct, act = like.coded[like.components[c][0]]
            length, symbol = luts[dct]
            p = pos[lanes]
            w = peek(p, 16)
            p, s = p + length[w], symbol[w]
            pred[lanes, c] += extra(p, s)
            p = p + s
            if c == 0:
                dc[lanes, m, b] = pred[lanes, 0]
            length, symbol = luts[16 | act]
            k = np.ones(len(p), np.int64)
            todo = None  # all lanes at first
            while True:
                q = p if todo is None else p[todo]
                w = peek(q, 16)
                s = symbol[w]
                q = q + length[w] + (s & 15)
                if not length[w].all():
                    raise ValueError("no such code")
                step = np.where(s == 0, 64, (s >> 4) + 1)
                if todo is None:
                    p, k = q, k + step
                    todo = np.flatnonzero(k < 64)
                else:
                    p[todo] = q
                    k[todo] += step
                    todo = todo[k[todo] < 64]
                if not len(todo):
                    break
            pos[lanes] = p
    out, lane = [], 0
    for i in images:
        down, across, v, h = i.grid
        n = -(-(down * across) // (i.restart or down * across))
        rows = dc[lane : lane + n].reshape(-1, first)
        if not even or rows.shape[0] != down * across:
            rows = np.concatenate([dc[lane + j, : mcus[lane + j]] for j in range(n)])
        out.append(rows.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h))
        lane += n
    return out


def thumbnails(media: list[bytes]) -> list[list[tuple[int, int, np.ndarray]]]:
    """(width, height, DC-only luminance as uint8) of each image in each value."""
    parsed: list[list[Image]] = []
    for data in media:
        images, at = [], 0
        while at < len(data):
            image, used = parse(data[at:] if at else data)
            images.append(image)
            at += used
        parsed.append(images)
    like: dict[tuple, list[tuple[int, int]]] = {}
    for m, images in enumerate(parsed):
        for n, i in enumerate(images):
            like.setdefault((tuple(sorted(i.tables.items())), tuple(i.components), tuple(sorted(i.coded.items()))), []).append((m, n))
    out: list[list] = [[None] * len(images) for images in parsed]
    for places in like.values():
        for (m, n), dc in zip(places, _decode([parsed[m][n] for m, n in places])):
            i = parsed[m][n]
            luma = np.clip(np.rint(dc * i.dc_quantisers[i.components[0][3]] / 8 + 128), 0, 255).astype(np.uint8)
            out[m][n] = (i.width, i.height, luma[: -(-i.height // 8), : -(-i.width // 8)])
    return out


def hashes(thumb: np.ndarray) -> tuple[int, int]:
    """Average hash and difference hash (64 bits each) of a thumbnail, over its 8x8 box means."""
    h, w = thumb.shape
    rows, cols = np.arange(8) * h // 8, np.arange(8) * w // 8
    boxes = np.add.reduceat(np.add.reduceat(thumb.astype(np.int64), rows, 0), cols, 1)
    area = np.maximum(np.diff(np.append(rows, h)), 1)[:, None] * np.maximum(np.diff(np.append(cols, w)), 1)
    means = boxes / area
    bits = lambda x: int.from_bytes(np.packbits(x.ravel()).tobytes(), "big")
    return bits(means > means.mean()), bits(means > np.roll(means, -1, axis=1))


def payload(text: str) -> tuple[int, bytes]:
    raw = text.encode()
    return len(raw), raw + b"\xff" * ((-len(raw)) % UNIT if raw else UNIT)


def _digest(data: bytes, n: int, images) -> tuple:
    """Of stored bytes: the payload as read back, and the thumbnail's features."""
    thumb = np.concatenate([t for _, _, t in images])
    read = thumb.tobytes()
    average, difference = hashes(thumb)
    feature = f"{images[0][0]}x{sum(i[1] for i in images)}/{len(images)}:{average:016x}:{difference:016x}"
    return n, len(read), hashlib.sha256(read).hexdigest(), zlib.crc32(read[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
_ARROW = pa.schema(list(zip([x.split()[0] for x in SCHEMA.split(", ")], _TYPES)))


def _stored(texts: list[str]):
    """(bytes long, stored bytes) of each text."""
    for a, b in chunks(texts, CHUNK):
        ready = [payload(t) for t in texts[a:b]]
        yield [(n, b"".join(images)) for (n, _), images in zip(ready, encode([p for _, p in ready]))]


@task("media")
def _round_trip(batches):
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        rows = []
        for stored in _stored(texts):
            rows += [_digest(data, n, images) for (n, data), images in zip(stored, thumbnails([d for _, d in stored]))]
        cols = list(zip(*rows)) or [()] * (len(_ARROW) - 1)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *[pa.array(c, t) for c, t in zip(cols, _TYPES[1:])]], schema=_ARROW)


@task("media")
def _media(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
    for batch in batches:
        rows = [r for stored in _stored([t or "" for t in batch.column("text").to_pylist()]) for r in stored]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], schema=schema)


def media_column(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the stored JPEG bytes (``media``) of each document's text."""
    bound_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_media, "doc_id long, n_bytes long, media binary")


@task("media")
def _describe(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("width", pa.int64()), ("height", pa.int64()), ("thumbnail", pa.binary()), ("average_hash", pa.string()), ("difference_hash", pa.string())])
    for batch in batches:
        rows = []
        for images in thumbnails([m or b"" for m in batch.column("media").to_pylist()]):
            thumb = np.concatenate([t for _, _, t in images]) if images else np.zeros((0, 0), np.uint8)
            a, d = hashes(thumb) if thumb.size else (0, 0)
            rows.append((max((i[0] for i in images), default=0), sum(i[1] for i in images), thumb.tobytes(), f"{a:016x}", f"{d:016x}"))
        cols = list(zip(*rows)) or [()] * 5
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *[pa.array(c, t) for c, t in zip(cols, schema.types[1:])]], schema=schema)


def described(media: DataFrame) -> DataFrame:
    """Dimensions, thumbnail and thumbnail hashes of a column ``media`` of baseline JPEGs (null: no image, all zero)."""
    bound_batches(media.sparkSession)
    return media.select("doc_id", "media").mapInArrow(_describe, "doc_id long, width long, height long, thumbnail binary, average_hash string, difference_hash string")


def digests(docs: DataFrame) -> DataFrame:
    """One row per document: its text is stored as JPEG, read back from the stored bytes and described."""
    bound_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_round_trip, SCHEMA)


def op2_jpeg_media(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
