"""Media columns: Netpbm and BMP images in numpy, area-resized through integral images, as NPY tiles with difference hashes."""

from __future__ import annotations

import io
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from marlstone.llm.common import map_columns

#: Width of the images that hold plain bytes, and the unit to which those are filled up.
WIDTH = 64


def pgm(image: np.ndarray) -> bytes:
    """A grey (h, w) or colour (h, w, 3) 8-bit image as binary Netpbm."""
    kind = b"P5" if image.ndim == 2 else b"P6"
    return kind + b"\n%d %d\n255\n" % (image.shape[1], image.shape[0]) + np.ascontiguousarray(image, np.uint8).tobytes()


def _numbers(data: bytes, at: int, count: int) -> tuple[list[int], int]:
    """``count`` numbers of a Netpbm header from ``at`` on, comments passed over, and where they end."""
    found: list[int] = []
    while len(found) < count:
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
        elif data[at : at + 1].isspace():
            at += 1
        else:
            end = at
            while data[end : end + 1].isdigit():
                end += 1
            if end == at:
                raise ValueError("not a Netpbm header")
            found.append(int(data[at:end]))
            at = end
    return found, at


def netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as an array, (h, w) or (h, w, 3), of 8 or 16 bits; bitmaps have black 0 and white 255."""
    kind, depth = data[1] - 48, 3 if data[1:2] in b"36" else 1
    (w, h, *top), at = _numbers(data, 2, 2 if kind in (1, 4) else 3)
    most = top[0] if top else 1
    if kind == 4:
        rows = np.frombuffer(data, np.uint8, h * ((w + 7) // 8), at + 1).reshape(h, -1)
        return ((1 - np.unpackbits(rows, axis=1)[:, :w]) * 255).astype(np.uint8)
    if kind == 1:
        bits = np.frombuffer(data[at:].translate(None, b" \t\r\n\x0b\x0c"), np.uint8)[: h * w].reshape(h, w) - 48
        return ((1 - bits) * 255).astype(np.uint8)
    if kind in (2, 3):
        values = np.array(_numbers(data, at, h * w * depth)[0])
    else:
        values = np.frombuffer(data, ">u2" if most > 255 else np.uint8, h * w * depth, at + 1)
    values = values.astype(np.uint16 if most > 255 else np.uint8)
    return values.reshape((h, w, 3) if depth == 3 else (h, w))


def bmp(data: bytes) -> np.ndarray:
    """An uncompressed BMP of 8, 24 or 32 bits as (h, w) or (h, w, 3) in red, green, blue."""
    offset = struct.unpack_from("<I", data, 10)[0]
    head, w, h, _, bits, packed = struct.unpack_from("<IiiHHI", data, 14)
    if packed not in (0, 3) or bits not in (8, 24, 32):
        raise ValueError("only uncompressed BMP images of 8, 24 or 32 bits are supported")
    stride = (w * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, abs(h) * stride, offset).reshape(abs(h), stride)
    rows = rows[::-1] if h > 0 else rows
    if bits == 8:
        used = struct.unpack_from("<I", data, 46)[0] or 256
        palette = np.zeros((256, 4), np.uint8)
        palette[:used] = np.frombuffer(data, np.uint8, used * 4, 14 + head).reshape(-1, 4)
        colours = palette[rows[:, :w]][..., 2::-1]
        return colours[..., 0] if (palette[:used, 0] == palette[:used, 1]).all() and (palette[:used, 1] == palette[:used, 2]).all() else colours
    return rows[:, : w * bits // 8].reshape(abs(h), w, bits // 8)[..., 2::-1]


def as_bmp(image: np.ndarray) -> bytes:
    """A colour (h, w, 3) image as a 24-bit BMP."""
    h, w = image.shape[:2]
    stride = (w * 3 + 3) // 4 * 4
    rows = np.zeros((h, stride), np.uint8)
    rows[:, : w * 3] = image[::-1, :, ::-1].reshape(h, -1)
    return b"BM" + struct.pack("<IHHI", 54 + rows.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def decode(data: bytes) -> np.ndarray:
    if data[:2] == b"BM":
        return bmp(data)
    if data[:1] == b"P" and data[1:2] in b"123456":
        return netpbm(data)
    raise ValueError("neither Netpbm nor BMP")


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else (image.astype(np.uint32) @ np.array([299, 587, 114], np.uint32)) // 1000


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """The mean of the area that each new pixel covers, cut pixels by their part, from one integral image; exact for integers."""
    h, w = image.shape
    sums = np.zeros((h + 1, w + 1), np.int64)
    np.cumsum(np.cumsum(image, axis=0, dtype=np.int64), axis=1, out=sums[1:, 1:])

    def along(table: np.ndarray, old: int, new: int) -> np.ndarray:
        """``table`` at the edges of the new pixels, times ``new``: between two old edges it is a straight line."""
        at = np.arange(new + 1) * old
        low, part = at // new, at % new
        high = np.minimum(low + 1, old)
        return table[low] * (new - part)[:, None] + table[high] * part[:, None]

    edges = along(along(sums, h, height).T, w, width).T
    boxes = edges[1:, 1:] - edges[:-1, 1:] - edges[1:, :-1] + edges[:-1, :-1]
    return boxes / (h * w)


def difference_hash(image: np.ndarray) -> str:
    """64 bits as 16 hex digits: in an 8 by 9 area-resized image, whether each pixel is brighter than its right neighbour."""
    tile = area_resize(grey(image), 8, 9)
    return np.packbits(tile[:, :-1] > tile[:, 1:]).tobytes().hex()


def tile(image: np.ndarray, side: int) -> bytes:
    """The image area-resized to ``side`` by ``side``, rounded to 8 bits, as an NPY file."""
    out = io.BytesIO()
    small = area_resize(grey(image), side, side)
    np.save(out, np.floor(small / (257 if image.dtype == np.uint16 else 1) + 0.5).astype(np.uint8))
    return out.getvalue()


def stored(text: str | None) -> tuple[int, bytes]:
    """How many bytes a text has, and the image that holds them and the zeros after them, one byte a pixel."""
    data = (text or "").encode("utf-8", "replace")
    rows = max(1, -(-len(data) // WIDTH))
    return len(data), pgm(np.frombuffer(data.ljust(rows * WIDTH, b"\0"), np.uint8).reshape(rows, WIDTH))


MEDIA = T.StructType([T.StructField(n, t) for n, t in (("id", T.LongType()), ("n_bytes", T.LongType()), ("media", T.BinaryType()), ("samples", T.BinaryType()), ("tile", T.BinaryType()), ("hash", T.StringType()))])


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", side: int = 32) -> DataFrame:
    """Texts kept as images, read back from the stored bytes: ``id``, ``n_bytes`` (of the text), ``media`` (the image file),
    ``samples`` (the bytes read back from it), ``tile`` (an NPY file) and ``hash`` (its difference hash, 16 hex digits).

    Each text's UTF-8 bytes, zeros up to a positive multiple of 64 after them, fill a grey image 64 pixels wide. A null text counts as
    empty: one row of zeros. Long texts make tall images, held one at a time; null ids, repeated rows and other columns change nothing.
    """

    def run(columns: list[pa.Array]) -> list:
        out: list[list] = [[], [], [], [], []]
        for text in columns[1]:
            n, media = stored(text.as_py())
            image = decode(media)
            for held, value in zip(out, (n, media, image.tobytes(), tile(image, side), difference_hash(image)), strict=True):
                held.append(value)
        return [columns[0].cast(pa.int64()), *out]

    return map_columns(docs, MEDIA, run, id_col, text_col)


IMAGE = T.StructType([T.StructField(n, t) for n, t in (("id", T.LongType()), ("height", T.IntegerType()), ("width", T.IntegerType()), ("tile", T.BinaryType()), ("hash", T.StringType()), ("error", T.StringType()))])


def images(files: DataFrame, id_col: str, data_col: str, side: int = 32) -> DataFrame:
    """Netpbm and BMP files of a binary column: ``id``, ``height``, ``width``, ``tile``, ``hash``, ``error``.

    A null, cut short or foreign file returns a row with its reason in ``error`` and nulls else; nothing is dropped.
    """

    def run(columns: list[pa.Array]) -> list:
        out: list[list] = [[], [], [], [], []]
        for data in columns[1]:
            try:
                image = decode(data.as_py() or b"")
                row = (image.shape[0], image.shape[1], tile(image, side), difference_hash(image), None)
            except (ValueError, IndexError, struct.error) as e:
                row = (None, None, None, None, str(e))
            for held, value in zip(out, row, strict=True):
                held.append(value)
        return [columns[0].cast(pa.int64()), *out]

    return map_columns(files, IMAGE, run, id_col, data_col)
