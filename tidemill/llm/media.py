"""Operator 2: media columns of Netpbm and BMP images.

Images are decoded to numpy arrays, resized by area from an integral image (its bilinear
values at fractional edges are exact sums over fractional pixels), written as NPY tiles and
given a difference hash.
"""

from __future__ import annotations

import io
import struct
import zlib
from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_batch, pick, stored, table, text_bytes

UNIT = 576
WIDTH = 24
#: A palette of all greys: blue, green, red and a zero each.
GREYS = b"".join(bytes((i, i, i, 0)) for i in range(256))


def _header(raw: bytes, n: int) -> tuple[list[int], int]:
    """n numbers after a Netpbm magic, with comments, and where the samples begin."""
    numbers, i = [], 2
    while len(numbers) < n:
        while raw[i : i + 1].isspace() or raw[i : i + 1] == b"#":
            if raw[i : i + 1] == b"#":
                i = raw.index(b"\n", i)
            i += 1
        start = i
        while raw[i : i + 1].isdigit():
            i += 1
        if start == i:
            raise ValueError("not a Netpbm header")
        numbers.append(int(raw[start:i]))
    return numbers, i + 1


def decode_netpbm(raw: bytes) -> np.ndarray:
    """P1 to P6 as (height, width) or (height, width, 3); 1 is black in bitmaps and becomes 0."""
    kind = raw[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not a Netpbm image")
    bitmap = kind in (b"P1", b"P4")
    numbers, at = _header(raw, 2 if bitmap else 3)
    width, height, most = *numbers[:2], 1 if bitmap else numbers[2]
    shape = (height, width, 3) if kind in (b"P3", b"P6") else (height, width)
    size = int(np.prod(shape))
    if kind == b"P4":
        rows = np.frombuffer(raw, np.uint8, height * ((width + 7) // 8), at).reshape(height, -1)
        return (1 - np.unpackbits(rows, axis=1)[:, :width]) * np.uint8(255)
    if kind in (b"P5", b"P6"):
        return np.frombuffer(raw, np.uint8 if most < 256 else ">u2", size, at).reshape(shape)
    body = raw[at - 1 :]
    if kind == b"P1":
        bits = np.frombuffer(bytes(b for b in body if b in b"01"), np.uint8)[:size] - 48
        return (1 - bits.reshape(shape)) * np.uint8(255)
    return np.array(body.split()[:size], dtype=np.uint8 if most < 256 else np.uint16).reshape(shape)


def encode_pgm(samples: np.ndarray) -> bytes:
    height, width = samples.shape
    return b"P5\n%d %d\n255\n" % (width, height) + samples.tobytes()


def decode_bmp(raw: bytes) -> np.ndarray:
    """Uncompressed 8-bit (palette), 24-bit and 32-bit BMP as (height, width, 3) RGB; (height, width) where a palette is all grey."""
    if raw[:2] != b"BM":
        raise ValueError("not a BMP image")
    at, head, width, height = struct.unpack_from("<I", raw, 10)[0], *struct.unpack_from("<Iii", raw, 14)
    depth, packed = struct.unpack_from("<HI", raw, 28)
    if depth not in (8, 24, 32) or packed not in (0, 3):
        raise ValueError("unsupported BMP")
    line = (width * depth // 8 + 3) // 4 * 4
    rows = np.frombuffer(raw, np.uint8, line * abs(height), at).reshape(abs(height), line)[:: -1 if height > 0 else 1]
    pixels = rows[:, : width * depth // 8].reshape(abs(height), width, depth // 8)
    if depth == 8:
        n = struct.unpack_from("<I", raw, 46)[0] or 256
        palette = np.frombuffer(raw, np.uint8, 4 * n, 14 + head).reshape(n, 4)[:, 2::-1]
        grey = (palette == palette[:, :1]).all()
        return palette[:, 0][pixels[:, :, 0]] if grey else palette[pixels[:, :, 0]]
    return pixels[:, :, 2::-1]


def encode_bmp(rgb: np.ndarray) -> bytes:
    height, width, _ = rgb.shape
    line = (3 * width + 3) // 4 * 4
    rows = np.zeros((height, line), np.uint8)
    rows[:, : 3 * width] = rgb[::-1, :, ::-1].reshape(height, -1)
    head = struct.pack("<2sIHHI", b"BM", 54 + rows.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, rows.size, 2835, 2835, 0, 0)
    return head + rows.tobytes()


def encode_grey_bmp(samples: np.ndarray) -> bytes:
    """8-bit BMP under a palette of all greys."""
    height, width = samples.shape
    rows = np.zeros((height, (width + 3) // 4 * 4), np.uint8)
    rows[:, :width] = samples[::-1]
    at = 54 + len(GREYS)
    head = struct.pack("<2sIHHI", b"BM", at + rows.size, 0, 0, at) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8, 0, rows.size, 2835, 2835, 256, 0)
    return head + GREYS + rows.tobytes()


def decode(raw: bytes) -> np.ndarray:
    return decode_bmp(raw) if raw[:2] == b"BM" else decode_netpbm(raw)


def _at(sums: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Values of cumulative sums along the first axis at fractional places."""
    low = np.minimum(edges.astype(np.int64), len(sums) - 2)
    part = (edges - low).reshape(-1, *[1] * (sums.ndim - 1))
    return sums[low] * (1 - part) + sums[low + 1] * part


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over equal areas, grey values in double precision."""
    grey = image if image.ndim == 2 else image @ np.array([0.299, 0.587, 0.114])
    sums = np.zeros((grey.shape[0] + 1, grey.shape[1] + 1))
    np.cumsum(np.cumsum(grey, axis=0, dtype=np.float64), axis=1, out=sums[1:, 1:])
    rows = np.diff(_at(sums, np.linspace(0, grey.shape[0], height + 1)), axis=0)
    cells = np.diff(_at(rows.T, np.linspace(0, grey.shape[1], width + 1)), axis=0).T
    return cells / (grey.shape[0] / height * (grey.shape[1] / width))


def tile(image: np.ndarray, height: int = 16, width: int = 16) -> bytes:
    """The resized image as an NPY file of 8-bit samples."""
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(area_resize(image, height, width)), 0, 255).astype(np.uint8), allow_pickle=False)
    return out.getvalue()


def difference_hash(image: np.ndarray) -> str:
    """64 bits: each of 8 x 9 cells against its right neighbour, as 16 hexadecimal digits.

    Cells are rounded to a millionth first, so that equal areas stay equal.
    """
    cells = np.round(area_resize(image, 8, 9), 6)
    return np.packbits(cells[:, 1:] > cells[:, :-1]).tobytes().hex()


def media_column(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media binary): each whole text as a grey image of width 24.

    The samples are the text's UTF-8 bytes, then bytes 255 up to a positive multiple of 576. An
    odd number of 576-byte blocks is stored as Netpbm, an even one as BMP, so the column holds
    both formats and equal texts have equal media. A null text counts as empty; null ids and
    repeated rows stay as they are; very long texts are images of as many rows; an empty table
    gives an empty one; other columns are dropped, whatever their names.
    """

    def make():
        def run(batch):
            raws = text_bytes(batch[1])
            media = []
            for raw in raws:
                payload = raw + b"\xff" * ((-len(raw)) % UNIT or UNIT * (not raw))
                samples = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
                media.append(encode_pgm(samples) if len(payload) // UNIT % 2 else encode_grey_bmp(samples))
            return {"doc_id": batch[0], "n_bytes": [len(r) for r in raws], "media": media}

        return run

    return per_batch(pick(docs, "doc_id", "text"), "doc_id long, n_bytes long, media binary", make)


def tiles(media: DataFrame, height: int = 16, width: int = 16, id_col: str = "doc_id") -> DataFrame:
    """(id, tile binary, dhash string): NPY tiles and difference hashes of a media column.

    Null media and bytes that are no such image give nulls.
    """

    def make():
        def run(batch):
            out = []
            for raw in batch[1].to_pylist():
                try:
                    image = decode(raw or b"")
                    out.append((tile(image, height, width), difference_hash(image)))
                except (ValueError, IndexError, struct.error):
                    out.append((None, None))
            return {id_col: batch[0], "tile": [t for t, _ in out], "dhash": [h for _, h in out]}

        return run

    return per_batch(pick(media, id_col, "media"), f"`{id_col}` long, tile binary, dhash string", make)


def digests(media: DataFrame) -> DataFrame:
    """Digests of what the stored media decode to, their features and their NPY tiles."""
    names = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary"

    def make():
        def run(batch):
            raws = [bytes(r) for r in batch[2].to_pylist()]
            images = [decode(r) for r in raws]
            payloads = [i.tobytes() for i in images]
            return {
                "doc_id": batch[0], "n_bytes": batch[1], "payload_bytes": [len(p) for p in payloads],
                "payload_sha256": [sha256(p).hexdigest() for p in payloads], "tail_crc32": [zlib.crc32(p[-32:]) for p in payloads],
                "media_bytes": [len(r) for r in raws], "media_sha256": [sha256(r).hexdigest() for r in raws],
                "feature": [difference_hash(i) for i in images], "tile": [tile(i) for i in images],
            }

        return run

    return per_batch(media, names, make)


def op2_media_columns(spark, sf_dir: str) -> DataFrame:
    """Media and NPY tiles are each written as a binary column and read back; tile_sha256 is of the tile as stored."""
    made = stored(digests(stored(media_column(table(spark, sf_dir, "documents")))))
    return made.withColumn("tile_sha256", F.sha2("tile", 256)).drop("tile")
