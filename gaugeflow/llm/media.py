"""Media columns (operator 7): AVI motion-JPEG clips.

A clip is a RIFF AVI file whose one video stream holds intra frames: each is a JPEG of the lossless process (SOF3,
predictor 1, 8-bit samples in grey), so any bytes survive. Decoding parses the RIFF index, decodes the frames and
detects shots: a cut stands where the histogram difference of neighbouring frames exceeds an adaptive threshold, the
mean of the shot's differences so far plus a multiple of their deviation.

Frames of many clips are coded together in numpy: the encoder turns every sample into a code and packs all bits at once,
the decoder steps through the sample positions with one lane per frame.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, settle, table, texts_as_bytes

WIDTH = HEIGHT = 24
FRAME = WIDTH * HEIGHT
FRAME_MICROS = 40_000
#: Frames that are coded together.
LANES = 4096
BINS = 16
#: A cut: histogram difference over mean + CUT deviations of the shot so far, and at least LEAST_CUT.
CUT, LEAST_CUT = 3.0, 0.2

# Difference categories of 8-bit samples, from the shortest code to the longest, and the number of codes of each length
# 1 to 16. The code of ones alone stays free, as the format asks.
_CATEGORIES = [3, 4, 7, 1, 2, 0, 5, 6, 8]
_PER_LENGTH = [0, 3, 0, 2, 2, 2] + [0] * 10


def _codes(per_length: list[int], values: list[int]) -> dict[int, tuple[int, int]]:
    """Category to (code, length), by the format's canonical rule."""
    out, code, it = {}, 0, iter(values)
    for length, n in enumerate(per_length, 1):
        for _ in range(n):
            out[next(it)] = (code, length)
            code += 1
        code <<= 1
    return out


def _encode_tables() -> tuple[np.ndarray, np.ndarray]:
    code, size = np.zeros(511, np.uint32), np.zeros(511, np.int64)
    known = _codes(_PER_LENGTH, _CATEGORIES)
    for d in range(-255, 256):
        cat = abs(d).bit_length()
        c, n = known[cat]
        code[d + 255] = c << cat | (d if d >= 0 else d + (1 << cat) - 1)
        size[d + 255] = n + cat
    return code, size


def _decode_table(per_length: list[int], values: list[int]) -> np.ndarray:
    """For each 16-bit window: difference * 32 + bits taken; -1 where no code fits."""
    out = np.full(1 << 16, -1, np.int32)
    for cat, (code, n) in _codes(per_length, values).items():
        for extra in range(1 << cat):
            d = extra if not cat or extra >> (cat - 1) else extra - (1 << cat) + 1
            lo = (code << cat | extra) << (16 - n - cat)
            out[lo : lo + (1 << (16 - n - cat))] = d * 32 + n + cat
    return out


_CODE, _SIZE = _encode_tables()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


JPEG_HEAD = (
    b"\xff\xd8"
    + _segment(0xC4, bytes([0, *_PER_LENGTH, *_CATEGORIES]))
    + _segment(0xC3, struct.pack(">BHHB3B", 8, HEIGHT, WIDTH, 1, 1, 0x11, 0))
    + _segment(0xDA, bytes([1, 1, 0, 1, 0, 0]))  # predictor 1, no point transform
)
JPEG_TAIL = b"\xff\xd9"


def encode_frames(frames: np.ndarray) -> list[bytes]:
    """Entropy-coded data of each frame. frames: (n, FRAME) bytes."""
    n = len(frames)
    x = frames.reshape(n, HEIGHT, WIDTH).astype(np.int16)
    d = np.empty_like(x)
    d[:, :, 1:] = x[:, :, 1:] - x[:, :, :-1]
    d[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
    d[:, 0, 0] = x[:, 0, 0] - 128
    at = d.reshape(n, FRAME) + 255
    size = _SIZE[at]
    bits = np.cumsum(size, axis=1)
    total = bits[:, -1]
    length = (total + 7) >> 3
    start = np.concatenate([[0], np.cumsum(length)])
    where = (bits - size + (start[:-1] * 8)[:, None]).ravel()
    value = _CODE[at].ravel() << (24 - size.ravel() - (where & 7)).astype(np.uint32)
    byte = where >> 3
    out = np.zeros(start[-1] + 2, np.uint8)
    for shift, k in ((16, 0), (8, 1), (0, 2)):
        np.add.at(out, byte + k, (value >> np.uint32(shift) & np.uint32(255)).astype(np.uint8))
    out[start[1:] - 1] |= ((1 << (-total & 7)) - 1).astype(np.uint8)  # filled up with ones
    out = out[: start[-1]]
    full = np.nonzero(out == 255)[0]
    stuffed = np.insert(out, full + 1, 0) if len(full) else out
    edges = (start + np.searchsorted(full, start)).tolist()
    buf = stuffed.tobytes()
    return [buf[a:z] for a, z in zip(edges, edges[1:])]


def decode_frames(data: list[bytes], lut: np.ndarray) -> np.ndarray:
    """(n, FRAME) samples of frames whose entropy-coded data are given."""
    n = len(data)
    buf = np.frombuffer(b"".join(data) + bytes(8), np.uint8)
    start = np.concatenate([[0], np.cumsum([len(x) for x in data])])[:-1]
    stuffing = np.nonzero((buf[:-1] == 255) & (buf[1:] == 0))[0] + 1
    if len(stuffing):
        start = start - np.searchsorted(stuffing, start)
        buf = np.delete(buf, stuffing)
    b = buf.astype(np.uint32)
    window = b[:-3] << np.uint32(24) | b[1:-2] << np.uint32(16) | b[2:-1] << np.uint32(8) | b[3:]
    at = start * 8
    last = len(window) - 1
    d = np.empty((FRAME, n), np.int32)
    for k in range(FRAME):
        v = lut[(window[np.minimum(at >> 3, last)] << (at & 7).astype(np.uint32)) >> np.uint32(16)]
        d[k] = v
        at = at + (v & 31)
    if (d == -1).any():
        raise ValueError("damaged frame")
    d = (d >> 5).T.reshape(n, HEIGHT, WIDTH)
    d[:, :, 0] = np.cumsum(d[:, :, 0], axis=1) + 128
    return np.cumsum(d, axis=2).astype(np.uint8).reshape(n, FRAME)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def _list(name: bytes, body: bytes) -> bytes:
    return _chunk(b"LIST", name + body)


def avi(coded: list[bytes], n_bytes: int) -> bytes:
    """The file of a clip; n_bytes, the payload's length before it was filled up, stands in its comment."""
    images = [JPEG_HEAD + c + JPEG_TAIL for c in coded]
    n, largest = len(images), max(map(len, images))
    avih = struct.pack("<14I", FRAME_MICROS, 0, 0, 0x10, n, 0, 1, largest, WIDTH, HEIGHT, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, FRAME_MICROS, 1_000_000, 0, n, largest, 0xFFFFFFFF, 0, 0, 0, WIDTH, HEIGHT)
    strf = struct.pack("<IiiHH4sIiiII", 40, WIDTH, HEIGHT, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    head = _list(b"hdrl", _chunk(b"avih", avih) + _list(b"strl", _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    info = _list(b"INFO", _chunk(b"ICMT", f"bytes={n_bytes}".encode()))
    index = np.zeros(n, np.dtype([("id", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")]))
    sizes = np.array([len(x) for x in images], np.int64)
    index["id"], index["flags"], index["size"] = b"00dc", 0x10, sizes
    index["at"] = 4 + np.concatenate([[0], np.cumsum(sizes + (sizes & 1) + 8)[:-1]])
    body = b"AVI " + head + info + _list(b"movi", b"".join(_chunk(b"00dc", x) for x in images)) + _chunk(b"idx1", index.tobytes())
    return b"RIFF" + struct.pack("<I", len(body)) + body


def parse(data: bytes) -> tuple[list[tuple[int, int]], int, int]:
    """Places of the frames by the index, microseconds a frame, and the payload's length by the comment."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, end, movi, index, micros, n_bytes = 12, 8 + struct.unpack_from("<I", data, 4)[0], None, None, FRAME_MICROS, -1
    while at + 8 <= end:
        name, size = struct.unpack_from("<4sI", data, at)
        kind = data[at + 8 : at + 12]
        if name == b"LIST" and kind == b"movi":
            movi = at + 8
        elif name == b"LIST" and kind == b"hdrl" and data[at + 12 : at + 16] == b"avih":
            micros = struct.unpack_from("<I", data, at + 20)[0]
        elif name == b"LIST" and kind == b"INFO" and data[at + 12 : at + 16] == b"ICMT":
            n_bytes = int(data[at + 20 : at + 20 + struct.unpack_from("<I", data, at + 16)[0]].partition(b"=")[2])
        elif name == b"idx1":
            index = np.frombuffer(data, np.dtype([("id", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")]), size // 16, at + 8)
        at += 8 + size + (size & 1)
    if movi is None or index is None:
        raise ValueError("no frames or no index")
    return [(movi + a + 8, n) for a, n in zip(index["at"].tolist(), index["size"].tolist())], micros, n_bytes


def scan_data(image: bytes) -> tuple[bytes, list[int], list[int]]:
    """A frame's entropy-coded data, and its code table as the DHT segment has it."""
    if image[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG image")
    at, lengths, values = 2, [], []
    while True:
        marker, size = image[at + 1], struct.unpack_from(">H", image, at + 2)[0]
        body = image[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xC4:
            lengths, values = list(body[1:17]), list(body[17 : 17 + sum(body[1:17])])
        elif marker == 0xC3 and struct.unpack_from(">BHH", body) != (8, HEIGHT, WIDTH):
            raise ValueError("another frame size")
        elif marker == 0xDA:
            return image[at:-2], lengths, values


def read_frames(files: list[bytes]) -> Iterator[tuple[np.ndarray, int]]:
    """Decoded frames (n, FRAME) and the payload's length of each file; frames of several files share a pass."""
    lut = _decode_table(_PER_LENGTH, _CATEGORIES)
    parsed, todo = [], []
    for f in files:
        places, _, n_bytes = parse(f)
        parsed.append((len(places), n_bytes))
        for a, n in places:
            if f.startswith(JPEG_HEAD, a):
                todo.append(f[a + len(JPEG_HEAD) : a + n - 2])
            else:
                data, lengths, values = scan_data(f[a : a + n])
                if (lengths, values) != (_PER_LENGTH, _CATEGORIES):
                    raise ValueError("another code table")
                todo.append(data)
    done = [decode_frames(todo[i : i + LANES], lut) for i in range(0, len(todo), LANES)]
    every = np.concatenate(done) if done else np.zeros((0, FRAME), np.uint8)
    at = 0
    for n, n_bytes in parsed:
        yield every[at : at + n], n_bytes
        at += n


def histograms(frames: np.ndarray) -> np.ndarray:
    n = len(frames)
    at = np.repeat(np.arange(n) * BINS, FRAME) + (frames.ravel() >> 4)
    return np.bincount(at, minlength=n * BINS).reshape(n, BINS)


def cuts(hist: np.ndarray) -> list[int]:
    """First frames of the shots, from 0."""
    if not len(hist):
        return []
    diff = (np.abs(np.diff(hist, axis=0)).sum(1) / (2 * FRAME)).tolist()
    found, n, total, squares = [0], 0, 0.0, 0.0
    for i, x in enumerate(diff, 1):
        mean = total / n if n else 0.0
        spread = max(0.0, squares / n - mean * mean) ** 0.5 if n else 0.0
        if x >= LEAST_CUT and x > mean + CUT * spread:
            found.append(i)
            n, total, squares = 0, 0.0, 0.0
        else:
            n, total, squares = n + 1, total + x, squares + x * x
    return found


def payload(text: bytes) -> bytes:
    return text + b"\xff" * (max(FRAME, -(-len(text) // FRAME) * FRAME) - len(text))


def encode_clips(docs: DataFrame) -> DataFrame:
    """doc_id, media: the text of each row (null: empty) as a clip, its UTF-8 bytes filled up with 255 to whole frames,
    one at least. Repeated rows give equal clips, an empty table none; other columns are not read."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        for b in batches:
            texts = texts_as_bytes(b.column("text"))
            filled = [payload(t) for t in texts]
            frames = np.frombuffer(b"".join(filled), np.uint8).reshape(-1, FRAME)
            coded: list[bytes] = []
            for i in range(0, len(frames), LANES):
                coded += encode_frames(frames[i : i + LANES])
            out, at = [], 0
            for t, p in zip(texts, filled):
                n = len(p) // FRAME
                out.append(avi(coded[at : at + n], len(t)))
                at += n
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, media binary")


def clips(media: DataFrame) -> DataFrame:
    """doc_id, clip (from 0), start_ms, end_ms, frames, luma (mean sample) of each shot of each file. A null file has
    no shot."""
    bound_batches(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        for b in batches:
            ids, files = zip(*[(i, f) for i, f in zip(b.column("doc_id").to_pylist(), b.column("media").to_pylist()) if f is not None]) if b.num_rows > b.column("media").null_count else ((), ())
            rows = []
            for i, (frames, _) in zip(ids, read_frames(list(files))):
                at = cuts(histograms(frames))
                for k, (a, z) in enumerate(zip(at, [*at[1:], len(frames)])):
                    rows.append((i, k, a * FRAME_MICROS // 1000, z * FRAME_MICROS // 1000, z - a, float(frames[a:z].mean())))
            cols = list(zip(*rows)) if rows else [()] * 6
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "clip", "start_ms", "end_ms", "frames", "luma"])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, clip int, start_ms long, end_ms long, frames long, luma double")


def digest(media: DataFrame) -> DataFrame:
    """What a file holds, from its stored bytes alone: the payload's length and digests, and the features of its shots."""
    bound_batches(media.sparkSession)
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        for b in batches:
            files = b.column("media").to_pylist()
            rows = []
            for i, f, (frames, n_bytes) in zip(b.column("doc_id").to_pylist(), files, read_frames(files)):
                p = frames.tobytes()
                hist = histograms(frames)
                at = cuts(hist)
                feature = f"frames={len(frames)};shots={len(at)};cuts={zlib.crc32(np.array(at, '<u4').tobytes()):08x};histogram={zlib.crc32(hist.astype('<u4').tobytes()):08x}"
                rows.append((i, n_bytes, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(f), hashlib.sha256(f).hexdigest(), feature))
            cols = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    return media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(encode_clips(table(spark, sf_dir, "documents")))
