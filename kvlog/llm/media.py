"""Operator 6: media columns. Netpbm and BMP bytes to numpy arrays, area-resized by integral images,
written as NPY tiles with difference hashes.

Images are arrays (height, width, channels) of 8 bits. Tiles are the NPY format's bytes of row bands
of at most ``TILE_ROWS`` rows, so that a very large image is stored and read in bounded pieces.

Edge cases: a null or empty text is 64 zero bytes. Equal texts give equal values; repeated rows are
repeated. A long text is several tiles; one at a time is read as a whole. Bytes that are no image of a
known kind raise ValueError in ``decode`` and give null in ``thumbnails``. An empty table gives an empty
result. Columns other than key and text, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_bytes

WIDTH, TILE_ROWS = 64, 1 << 14


def _header(data: bytes, fields: int) -> tuple[list[int], int]:
    """Numbers after a Netpbm magic, comments skipped, and where the samples begin."""
    found, at = [], 2
    while len(found) < fields:
        while at < len(data) and data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.find(b"\n", at) + 1 or len(data)
            continue
        end = at
        while end < len(data) and data[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("a Netpbm header needs numbers")
        found.append(int(data[at:end]))
        at = end
    return found, at + 1


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6; samples of other depths are scaled to 8 bits."""
    kind = data[1:2]
    if data[:1] != b"P" or kind not in b"123456":
        raise ValueError("not Netpbm")
    bitmap, plain, channels = kind in b"14", kind in b"123", 3 if kind in b"36" else 1
    numbers, at = _header(data, 2 if bitmap else 3)
    width, height, most = *numbers[:2], 1 if bitmap else numbers[2]
    n = width * height * channels
    if plain:
        body = b" ".join(x.split(b"#")[0] for x in data[at - 1 :].split(b"\n"))
        flat = np.frombuffer(bytes(c for c in body if c in b"01"), np.uint8)[:n] - 48 if bitmap else np.array(body.split()[:n], np.int64)
    elif bitmap:
        rows = np.frombuffer(data, np.uint8, -(-width // 8) * height, at).reshape(height, -1)
        flat = np.unpackbits(rows, axis=1)[:, :width].ravel()
    else:
        flat = np.frombuffer(data, np.uint8 if most < 256 else ">u2", n, at)
    if len(flat) != n:
        raise ValueError("Netpbm samples are missing")
    if bitmap:
        flat = (1 - flat.astype(np.uint8)) * np.uint8(255)
    elif most != 255:
        flat = (flat.astype(np.int64) * 255 + most // 2) // most
    return np.asarray(flat, np.uint8).reshape(height, width, channels)


def _masked(values: np.ndarray, mask: int) -> np.ndarray:
    """The bits under a mask, scaled to 8."""
    if not mask:
        return np.zeros(values.shape, np.uint8)
    shift = (mask & -mask).bit_length() - 1
    most = mask >> shift
    return (((values & mask) >> shift) * 255 + most // 2) // most


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8 (palette), 24 or 32 bits, or of 16 or 32 bits under masks, bottom-up or
    top-down, as RGB."""
    if data[:2] != b"BM":
        raise ValueError("not BMP")
    begin, size, width, height, _, bits, packing = struct.unpack_from("<I IiiHHI", data, 10)
    if packing not in (0, 3) or bits not in (1, 4, 8, 16, 24, 32) or (packing == 3 and bits not in (16, 32)):
        raise ValueError("this kind of BMP isn't read")
    rows = abs(height)
    stride = (width * bits + 31) // 32 * 4
    raw = np.frombuffer(data, np.uint8, stride * rows, begin).reshape(rows, stride)
    if packing == 3 or bits == 16:
        # Three masks follow the first 40 bytes of the header; 16 bits without masks have 5 for a colour.
        masks = struct.unpack_from("<III", data, 54) if packing == 3 else (0x7C00, 0x3E0, 0x1F)
        values = raw[:, : width * bits // 8].copy().view("<u2" if bits == 16 else "<u4").astype(np.int64)
        out = np.stack([_masked(values, m) for m in masks], axis=2)
    elif bits <= 8:
        colours = struct.unpack_from("<I", data, 46)[0] or 1 << bits
        palette = np.frombuffer(data, np.uint8, colours * 4, 14 + size).reshape(-1, 4)[:, 2::-1]
        index = raw if bits == 8 else np.unpackbits(raw, axis=1) if bits == 1 else np.stack([raw >> 4, raw & 15], axis=2).reshape(rows, -1)
        out = palette[index[:, :width]]
    else:
        out = raw[:, : width * bits // 8].reshape(rows, width, bits // 8)[:, :, 2::-1]
    return np.ascontiguousarray(out[::-1] if height > 0 else out, np.uint8)


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def encode_pgm(samples: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % samples.shape[1::-1] + samples.tobytes()


def _integral(values: np.ndarray, size: int) -> np.ndarray:
    """Sums of ``size`` equal spans along the first axis, whose ends may lie inside a value, from the
    running sum at their ends. Between the whole values at the ends only sums are held."""
    n = len(values)
    ends = np.arange(size + 1) * n / size
    whole = np.minimum(ends.astype(np.int64), n - 1)
    spans = np.unique(whole)
    sums = np.add.reduceat(values, spans, axis=0, dtype=np.float64)
    running = np.concatenate([np.zeros((1, *sums.shape[1:])), np.cumsum(sums, axis=0)])
    at = running[np.searchsorted(spans, whole)] + (ends - whole).reshape(-1, *[1] * (values.ndim - 1)) * values[whole]
    return np.diff(at, axis=0)


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """The mean of the area under each output pixel, as floats."""
    down = _integral(image, height)
    across = _integral(down.swapaxes(0, 1), width).swapaxes(0, 1)
    return across * (height * width / (image.shape[0] * image.shape[1]))


def difference_hash(image: np.ndarray) -> str:
    """64 bits: whether each of 8 x 9 area means, as grey, is below its right neighbour."""
    small = np.round(resize(image, 8, 9).mean(axis=2), 6)  # equal areas are equal, whatever the sums' last bits
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def to_tiles(image: np.ndarray) -> list[bytes]:
    """NPY bytes of bands of rows."""
    out = []
    for at in range(0, max(1, len(image)), TILE_ROWS):
        held = io.BytesIO()
        np.save(held, image[at : at + TILE_ROWS], allow_pickle=False)
        out.append(held.getvalue())
    return out


def from_tiles(tiles: list[bytes]) -> np.ndarray:
    return np.concatenate([np.load(io.BytesIO(x), allow_pickle=False) for x in tiles])


def thumbnails(media: DataFrame, key: str, data: str, height: int, width: int) -> DataFrame:
    """key, the NPY tiles of the area-resized image and its difference hash; null if it isn't read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tiles, hashes = [], []
            for x in batch.column(1).to_pylist():
                try:
                    image = decode(x or b"")
                    tiles.append(to_tiles(np.rint(resize(image, height, width)).astype(np.uint8)))
                    hashes.append(difference_hash(image))
                except (ValueError, struct.error, IndexError, TypeError, ZeroDivisionError):
                    tiles.append(None)
                    hashes.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tiles, pa.list_(pa.binary())), pa.array(hashes, pa.string())], ["key", "tiles", "dhash"])

    kind = media.schema[key].dataType.simpleString()
    return media.select(F.col(key).alias("key"), F.col(data).alias("d")).mapInArrow(run, f"key {kind}, tiles array<binary>, dhash string").withColumnRenamed("key", key)


def store(data: bytes) -> list[bytes]:
    """A payload of a multiple of 64 bytes as an image 64 wide: a grey Netpbm file, decoded, as tiles."""
    return to_tiles(decode(encode_pgm(np.frombuffer(data, np.uint8).reshape(-1, WIDTH, 1))))


_FIELDS = {"n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}


def stored_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and, of each text stored as an image, sizes and digests of the tiles and of what is read back."""

    def one(data: bytes) -> tuple:
        n = len(data)
        tiles = store(data + b"\0" * (-n % WIDTH if n else WIDTH))
        image = from_tiles(tiles)
        payload, media = image.tobytes(), hashlib.sha256()
        for x in tiles:
            media.update(x)
        return n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), sum(map(len, tiles)), media.hexdigest(), difference_hash(image)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(one(x.as_py()) for x in batch.column(1)), strict=True)) or [()] * len(_FIELDS)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(rows, _FIELDS.values(), strict=True))], ["key", *_FIELDS])

    kind = docs.schema[key].dataType.simpleString()
    out = f"key {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return docs.select(F.col(key).alias("key"), text_bytes(text).alias("t")).mapInArrow(run, out).withColumnRenamed("key", key)


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_texts(table(spark, sf_dir, "documents"))


QUERIES = {"op6_media": op6_media}
ORACLES: dict[str, str] = {}
