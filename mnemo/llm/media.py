"""Media columns: Netpbm and BMP images, resized by integral images, with tiles and difference hashes.

Each image is worked on by itself in Arrow batches, so there is no shuffle and
a lost task is simply run again.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

_HEADER = re.compile(rb"(?:\s|#[^\n]*\n)*([^\s#]+)")


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as an array of height x width (x 3); bitmaps give 0 for black and 255 for white."""
    kind, at, numbers = data[:2], 2, []
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not a Netpbm image")
    while len(numbers) < (2 if kind in (b"P1", b"P4") else 3):
        m = _HEADER.match(data, at)
        if not m:
            raise ValueError("a Netpbm header is cut off")
        numbers.append(int(m[1]))
        at = m.end()
    w, h, most = (*numbers, 1)[:3]
    depth = 3 if kind in (b"P3", b"P6") else 1
    if kind == b"P1":
        values = np.array([b - 48 for b in re.sub(rb"#[^\n]*\n|\s", b"", data[at:])], np.uint8)
    elif kind in (b"P2", b"P3"):
        values = np.array(re.sub(rb"#[^\n]*\n", b"", data[at:]).split(), np.int64)
    elif kind == b"P4":
        rows = np.frombuffer(data, np.uint8, (w + 7) // 8 * h, at + 1).reshape(h, -1)
        values = np.unpackbits(rows, axis=1)[:, :w].ravel()
    else:
        values = np.frombuffer(data, ">u2" if most > 255 else np.uint8, w * h * depth, at + 1)
    if len(values) < w * h * depth:
        raise ValueError("a Netpbm raster is cut off")
    values = values[: w * h * depth].astype(np.uint16 if most > 255 else np.uint8)
    if kind in (b"P1", b"P4"):
        values = (1 - values) * np.uint8(255)
    return values.reshape((h, w, 3) if depth == 3 else (h, w))


def encode_pgm(pixels: np.ndarray) -> bytes:
    h, w = pixels.shape
    return b"P5\n%d %d\n255\n" % (w, h) + pixels.astype(np.uint8, copy=False).tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 24 or 32 bits, as gray (gray palettes) or RGB."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP image")
    start, head, w, h, _, bits, packed = struct.unpack_from("<xxxxxxxxxxIIiiHHI", data)
    if packed not in (0, 3) or bits not in (1, 4, 8, 24, 32):
        raise ValueError("a kind of BMP that is not read")
    rows = np.frombuffer(data, np.uint8, (w * bits + 31) // 32 * 4 * abs(h), start).reshape(abs(h), -1)
    rows = rows[::-1] if h > 0 else rows
    if bits >= 24:
        return rows[:, : w * bits // 8].reshape(abs(h), w, bits // 8)[:, :, 2::-1].copy()
    index = rows if bits == 8 else np.unpackbits(rows, axis=1) if bits == 1 else np.stack([rows >> 4, rows & 15], 2).reshape(len(rows), -1)
    n = struct.unpack_from("<I", data, 46)[0] or 1 << bits
    palette = np.zeros((1 << bits, 3), np.uint8)
    palette[:n] = np.frombuffer(data, np.uint8, 4 * n, 14 + head).reshape(n, 4)[:, 2::-1]
    colours = palette[index[:, :w]]
    return colours[:, :, 0] if (palette == palette[:, :1]).all() else colours


def encode_bmp(pixels: np.ndarray) -> bytes:
    """An 8-bit gray BMP, bottom row first."""
    h, w = pixels.shape
    rows = np.zeros((h, (w + 3) // 4 * 4), np.uint8)
    rows[:, :w] = pixels[::-1]
    gray = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4).copy()
    gray[:, 3] = 0
    head = struct.pack("<2sIIIIiiHHIIiiII", b"BM", 1078 + rows.size, 0, 1078, 40, w, h, 1, 8, 0, rows.size, 2835, 2835, 256, 0)
    return head + gray.tobytes() + rows.tobytes()


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def area_resize(pixels: np.ndarray, h: int, w: int) -> np.ndarray:
    """Mean over each of ``h`` x ``w`` equal areas, edges in proportion, from one integral image."""
    if pixels.ndim == 3:
        pixels = pixels[:, :, :3] @ np.array([0.299, 0.587, 0.114])
    rows, cols = pixels.shape
    total = np.zeros((rows + 1, cols + 1))
    np.cumsum(np.cumsum(pixels, 0, dtype=np.float64), 1, out=total[1:, 1:])

    def at(n: int, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = np.arange(parts + 1) * n / parts
        low = np.minimum(x.astype(np.int64), n)
        return low, np.minimum(low + 1, n), x - low

    (r0, r1, fr), (c0, c1, fc) = at(rows, h), at(cols, w)
    band = total[r0] * (1 - fr)[:, None] + total[r1] * fr[:, None]
    corner = band[:, c0] * (1 - fc) + band[:, c1] * fc
    return np.diff(np.diff(corner, axis=0), axis=1) / (rows / h * cols / w)


def difference_hash(pixels: np.ndarray) -> str:
    """64 bits, row by row: whether a cell of the 8 x 9 reduction is darker than its right neighbour."""
    small = np.rint(area_resize(pixels, 8, 9) * 1024)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy_tile(pixels: np.ndarray, side: int = 8) -> bytes:
    """The ``side`` x ``side`` reduction as an NPY file of unsigned bytes."""
    tile = np.rint(area_resize(pixels, side, side)).astype(np.uint8)
    head = f"{{'descr': '|u1', 'fortran_order': False, 'shape': ({side}, {side}), }}"
    head += " " * (-(len(head) + 11) % 64) + "\n"
    return b"\x93NUMPY\x01\x00" + struct.pack("<H", len(head)) + head.encode() + tile.tobytes()


def image_features(images: Column) -> Column:
    """For a column of encoded images: size, difference hash and tile; ``ok`` is false where one is null or can't be read."""

    def one(data: bytes | None) -> tuple:
        try:
            pixels = decode(bytes(data))
            return True, pixels.shape[0], pixels.shape[1], difference_hash(pixels), npy_tile(pixels)
        except (TypeError, ValueError, IndexError, struct.error):
            return False, None, None, None, None

    @pandas_udf("ok boolean, height int, width int, feature string, tile binary")
    def features(batch: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(x) for x in batch], columns=["ok", "height", "width", "feature", "tile"])

    return features(images)


def stored_text(text: str | None, kind: str, width: int = 64) -> tuple:
    raw = (text or "").encode()
    payload = raw + bytes(-len(raw) % width if raw else width)
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, width)
    media = encode_pgm(pixels) if kind == "pgm" else encode_bmp(pixels)
    image = decode(media)
    back = image.tobytes()
    return (
        len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-width:]), media, len(media),
        hashlib.sha256(media).hexdigest(), difference_hash(image), npy_tile(image),
    )


STORED = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media binary, media_bytes long, media_sha256 string, feature string, tile binary"


def text_media(text: Column, kind: str = "pgm", with_media: bool = True) -> Column:
    """A struct for each text: its bytes stored as the rows, 64 wide, of a gray image, and what is read back.

    A null or empty text is stored as 64 zero bytes.  Equal texts give equal structs.
    """

    @pandas_udf(STORED)
    def store(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in STORED.split(", ")]
        for texts in batches:
            out = pd.DataFrame([stored_text(x, kind) for x in texts], columns=names)
            yield out if with_media else out.assign(media=None, tile=None)

    return store(text)


def media_columns(docs: DataFrame, text: str = "text", kind: str = "pgm", with_media: bool = True) -> DataFrame:
    """``docs`` with the fields of ``text_media``; its columns of the same names are replaced. An empty table gives an empty one."""
    made = [x.split()[0] for x in STORED.split(", ")]
    held = [F.col(f"`{c}`") for c in docs.columns if c not in made]
    return docs.select(*held, text_media(F.col(text), kind, with_media).alias("_media")).select(*held, "_media.*")
