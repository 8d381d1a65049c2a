"""Media columns: Netpbm and BMP decoded to arrays, area-resized by integral images, written as NPY tiles.

An integral image has at each place the sum of all samples above and left of it, so the mean of any box,
whole or in part, is four look-ups whatever the box's size; long images go through it by bands of rows, of which only those are
kept that box edges lie between. A tile is an image's area-resized thumbnail as
the bytes of an NPY file; a difference hash says of each sample of an (h, w+1) thumbnail whether the next
is brighter. Images are handled one at a time where they lie; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_texts, read

#: Payloads are padded to multiples of UNIT bytes, the samples of a square of SIDE.
SIDE, PAD = 24, 255
UNIT = SIDE * SIDE
TILE, HASH = (16, 16), (8, 8)
#: Samples of a band whose integral image is held at once.
BAND = 1 << 20
_TOKEN = re.compile(rb"(?:\s|#[^\n]*\n)*([^\s#]+)")


def decode_netpbm(data: bytes) -> tuple[np.ndarray, int]:
    """P1 to P6 to (rows, columns) or (rows, columns, 3), and the largest sample that the header allows.

    Samples have up to 16 bits; bitmaps are 0 (black) and 1.
    """
    kind, at = data[:2], 2
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not Netpbm")
    values = []
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        got = _TOKEN.match(data, at)
        if not got or not got[1].isdigit():
            raise ValueError("not a Netpbm header")
        values.append(int(got[1]))
        at = got.end()
    width, height, top = (*values, 1)[:3]
    if not 0 < top < 1 << 16:
        raise ValueError(f"Netpbm with samples up to {top}")
    depth = 3 if kind in (b"P3", b"P6") else 1
    shape = (height, width, 3) if depth == 3 else (height, width)
    if kind == b"P4":
        stride = (width + 7) // 8
        rows = np.frombuffer(data, np.uint8, height * stride, at + 1).reshape(height, stride)
        return 1 - np.unpackbits(rows, axis=1)[:, :width], top
    wide = np.dtype(">u2") if top > 255 else np.dtype(np.uint8)
    if kind in (b"P5", b"P6"):
        samples = np.frombuffer(data, wide, height * width * depth, at + 1)
    elif kind == b"P1":
        samples = 49 - np.frombuffer(re.sub(rb"#[^\n]*\n|\s", b"", data[at:]), np.uint8, height * width)
    else:
        samples = np.array(data[at:].split(None, height * width * depth)[: height * width * depth], int)
    samples = samples.reshape(shape)
    if samples.size and not 0 <= samples.min() <= samples.max() <= top:
        raise ValueError(f"Netpbm with a sample outside 0 to {top}")
    return samples.astype(wide.newbyteorder("="), copy=False), top


def encode_pgm(samples: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % samples.shape[::-1] + samples.tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 8 bits (by palette) or 24 to (rows, columns) if grey, else (rows, columns, 3)."""
    if data[:2] != b"BM":
        raise ValueError("not BMP")
    (at,) = struct.unpack_from("<I", data, 10)
    head, width, height, _, bits, packed, _, _, _, used, _ = struct.unpack_from("<IiiHHIIiiII", data, 14)
    if packed or bits not in (8, 24) or width < 0 or used < 0:
        raise ValueError(f"BMP of {bits} bits, compression {packed}, width {width}")
    stride = (width * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, abs(height) * stride, at).reshape(abs(height), stride)[:, : width * bits // 8]
    rows = rows[::-1] if height > 0 else rows
    if bits == 24:
        return rows.reshape(abs(height), width, 3)[:, :, ::-1]
    palette = np.frombuffer(data, np.uint8, 4 * (used or 256), 14 + head).reshape(-1, 4)[:, 2::-1]
    if rows.size and rows.max() >= len(palette):
        raise ValueError(f"BMP with a sample beyond its {len(palette)} colours")
    grey = (palette == palette[:, :1]).all()
    return palette[:, 0][rows] if grey else palette[rows]


def encode_bmp(samples: np.ndarray) -> bytes:
    """Grey samples as an 8-bit BMP whose palette is the greys; rows from the bottom up, padded to four bytes."""
    height, width = samples.shape
    rows = np.pad(samples[::-1], ((0, 0), (0, -width % 4))).tobytes()
    palette = b"".join(bytes((i, i, i, 0)) for i in range(256))
    at = 14 + 40 + len(palette)
    return b"BM" + struct.pack("<IHHI", at + len(rows), 0, 0, at) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8, 0, len(rows), 2835, 2835, 256, 0) + palette + rows


def decode(data: bytes) -> tuple[np.ndarray, int]:
    """The samples, and the largest that their format allows."""
    return (decode_bmp(data), 255) if data[:2] == b"BM" else decode_netpbm(data)


def area_resize(image: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Each output sample is the mean of its box of the image, parts of samples included; float64."""
    if not image.size:
        return np.zeros((*shape, *image.shape[2:]))
    height, width = image.shape[:2]

    def edges(n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The edges of n equal boxes: the sample each lies in, and how far in."""
        at = np.linspace(0, size, n + 1)
        low = np.minimum(at.astype(int), size - 1)
        return low, at - low

    low, part = edges(shape[0], height)
    wanted = np.unique(np.concatenate([low, low + 1]))
    rows = np.zeros((len(wanted), width + 1, *image.shape[2:]))  # of the integral image, those that are asked for
    carry, step = np.zeros(image.shape[1:]), max(1, BAND // max(1, width))
    for start in range(0, height, step):
        sums = image[start : start + step].cumsum(axis=0, dtype=np.float64) + carry
        mine = np.flatnonzero((wanted > start) & (wanted <= start + len(sums)))
        rows[mine, 1:] = sums[wanted[mine] - start - 1].cumsum(axis=1)
        carry = sums[-1]

    def between(sums: np.ndarray, low: np.ndarray, high: np.ndarray, part: np.ndarray, axis: int) -> np.ndarray:
        """Sums at the edges, linear between samples."""
        part = part.reshape([-1 if k == axis else 1 for k in range(sums.ndim)])
        return np.take(sums, low, axis) * (1 - part) + np.take(sums, high, axis) * part

    boxes = between(rows, np.searchsorted(wanted, low), np.searchsorted(wanted, low + 1), part, 0)
    low, part = edges(shape[1], width)
    boxes = between(boxes, low, low + 1, part, 1)
    return np.diff(np.diff(boxes, axis=0), axis=1) * (shape[0] * shape[1] / (height * width))


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else image @ np.array([0.299, 0.587, 0.114])


def tile(image: np.ndarray, shape: tuple[int, int] = TILE, top: int = 255) -> bytes:
    """The thumbnail as the bytes of an NPY file of 8-bit samples, whatever the largest sample ``top`` of the image's format."""
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(area_resize(image, shape) * (255 / top)), 0, 255).astype(np.uint8))
    return out.getvalue()


def difference_hash(image: np.ndarray, shape: tuple[int, int] = HASH) -> str:
    small = area_resize(grey(image), (shape[0], shape[1] + 1))
    return np.packbits(np.diff(small, axis=1) > 1e-9).tobytes().hex()


def store(payload: bytes) -> bytes:
    """A payload of whole UNITs as samples of an image SIDE wide: BMP if the number of units is even, else PGM."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, SIDE)
    return encode_pgm(samples) if len(payload) // UNIT % 2 else encode_bmp(samples)


def media_columns(media: DataFrame, shape: tuple[int, int] = TILE) -> DataFrame:
    """``(media_id, height, width, channels, tile, dhash, error)`` of ``media`` (``media_id``, ``bytes``).

    ``tile`` is NPY bytes. Null, empty or undecodable bytes: nulls, and what is wrong in ``error``. Repeated
    rows get equal values. Other columns are left out. Empty table: empty result.
    """
    schema = f"media_id {media.schema['media_id'].dataType.simpleString()}, height int, width int, channels int, tile binary, dhash string, error string"

    def one(data: bytes | None) -> dict:
        try:
            image, top = decode(data or b"")
            return {"height": image.shape[0], "width": image.shape[1], "channels": image.shape[2] if image.ndim == 3 else 1, "tile": tile(image, shape, top), "dhash": difference_hash(image), "error": None}
        except (ValueError, struct.error, OverflowError) as e:
            return dict.fromkeys(("height", "width", "channels", "tile", "dhash")) | {"error": str(e) or type(e).__name__}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("height", pa.int32()), ("width", pa.int32()), ("channels", pa.int32()), ("tile", pa.binary()), ("dhash", pa.string()), ("error", pa.string())])
        for b in batches:
            made = pa.RecordBatch.from_pylist([one(x) for x in b.column("bytes").to_pylist()], schema=kinds)
            yield pa.RecordBatch.from_arrays([b.column("media_id"), *made.columns], names=["media_id", *kinds.names])

    return media.select("media_id", "bytes").mapInArrow(run, schema)


def text_media(docs: DataFrame) -> DataFrame:
    """Texts stored as images and read back: sizes, digests and a feature per row of ``docs`` (``doc_id``, ``text``).

    Null text is empty, and an empty payload is one unit of padding. The feature is the difference hash and the
    tile's digest. Repeated rows and equal texts get equal values. Other columns are left out. Empty table: empty result.
    """

    def one(text: str | None) -> tuple:
        raw = (text or "").encode("utf-8", "surrogatepass")
        stored = store(raw + bytes([PAD]) * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw)))
        image, _ = decode(stored)
        back = np.ascontiguousarray(image).tobytes()
        feature = f"{difference_hash(image)}:{hashlib.md5(tile(image)).hexdigest()[:16]}"
        return len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature

    columns = {"n_bytes": "long", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string"}

    def make(texts: list[str | None]) -> dict[str, list]:
        return dict(zip(columns, zip(*map(one, texts), strict=True) if texts else [[]] * len(columns), strict=True))

    return map_texts(docs, make, ", ".join(f"{k} {v}" for k, v in columns.items()))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(read(spark, sf_dir, "documents"))
