"""Images in rows: headers, decoding, resizing. Vectorised UDFs over small helpers; only what the format needs is read.

PNG is decoded in full (8 bits a channel, not interlaced); the headers of PNG, GIF, BMP and JPEG are understood.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_PNG = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def header(data: bytes | None) -> tuple[str, int, int] | None:
    """(format, width, height) of an image's bytes; None where no header is understood."""
    if not data:
        return None
    try:
        if data[:8] == _PNG and data[12:16] == b"IHDR":
            return ("png", *struct.unpack(">II", data[16:24]))
        if data[:6] in (b"GIF87a", b"GIF89a"):
            return ("gif", *struct.unpack("<HH", data[6:10]))
        if data[:2] == b"BM":
            w, h = struct.unpack("<ii", data[18:26])
            return "bmp", w, abs(h)
        if data[:3] == b"\xff\xd8\xff":
            at = 2
            while at + 9 < len(data):
                kind, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
                if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):  # a frame's header
                    h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                    return "jpeg", w, h
                at += 2 + size
    except struct.error:
        return None
    return None


def decode_png(data: bytes) -> np.ndarray:
    """Rows, columns, channels of a PNG; an error for what isn't one."""
    if data[:8] != _PNG:
        raise ValueError("not a PNG")
    at, body, palette = 8, b"", None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body += part
        at += 12 + size
    if depth != 8 or interlaced:
        raise ValueError("only 8 bits a channel, not interlaced")
    n = _CHANNELS[colour]
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, 1 + width * n)
    out = np.zeros((height, width * n), np.uint8)
    for y in range(height):
        out[y] = _unfiltered(int(raw[y, 0]), raw[y, 1:], out[y - 1] if y else np.zeros(width * n, np.uint8), n)
    pixels = out.reshape(height, width, n)
    return palette[pixels[:, :, 0]] if colour == 3 else pixels


def verified_png(read, step: int = 1 << 20) -> int | None:
    """Height of the PNG that ``read(offset, size)`` gives, if its pieces are whole and unpack to the lines that its header
    promises; None if they don't. Pixels aren't made, and about ``step`` bytes are held at a time."""
    try:
        head = read(0, 33)
        if head[:8] != _PNG or head[8:16] != b"\0\0\0\rIHDR" or zlib.crc32(head[12:29]) != int.from_bytes(head[29:33]):
            return None
        width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", head[16:29])
        line = 1 + (width * depth * _CHANNELS[colour] + 7) // 8
        unpack, n, at = zlib.decompressobj(), 0, 33
        while True:
            size, kind = struct.unpack(">I4s", read(at, 8))
            check, left, place = zlib.crc32(kind), size, at + 8
            while left:
                part = read(place, min(step, left))
                if not part:
                    return None
                check, left, place = zlib.crc32(part, check), left - len(part), place + len(part)
                while kind == b"IDAT" and part:
                    n += len(unpack.decompress(part, step))
                    part = unpack.unconsumed_tail
            if read(place, 4) != check.to_bytes(4):
                return None
            if kind == b"IEND":
                break
            at = place + 4
        n += len(unpack.flush())
        return height if unpack.eof and (n > 0 if interlaced else n == line * height) else None
    except (struct.error, zlib.error, KeyError):
        return None


def _unfiltered(kind: int, line: np.ndarray, up: np.ndarray, n: int) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 2:
        return line + up
    if kind == 1:
        return np.cumsum(line.reshape(-1, n), axis=0, dtype=np.uint8).ravel()
    out, upper = [0] * n + line.tolist(), [0] * n + up.tolist()
    for i in range(n, len(out)):
        a, b, c = out[i - n], upper[i], upper[i - n]
        if kind == 3:
            guess = (a + b) // 2
        else:
            da, db, dc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            guess = a if da <= db and da <= dc else b if db <= dc else c
        out[i] = (out[i] + guess) & 255
    return np.array(out[n:], np.uint8)


def encode_png(pixels: np.ndarray) -> bytes:
    height, width, n = pixels.shape
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    body = zlib.compress(np.hstack([np.zeros((height, 1), np.uint8), pixels.reshape(height, width * n)]).tobytes())
    colour = {1: 0, 2: 4, 3: 2, 4: 6}[n]
    return _PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)) + chunk(b"IDAT", body) + chunk(b"IEND", b"")


def _bicubic(into: int, of: int) -> np.ndarray:
    """Weights (into, of) of a bicubic resize; when shrinking, the kernel is widened so that no pixel is skipped."""
    scale = of / into
    wide = max(scale, 1.0)
    centre = (np.arange(into)[:, None] + 0.5) * scale - 0.5
    x = np.abs((np.arange(of)[None, :] - centre) / wide)
    a = -0.5
    w = np.where(x < 1, (a + 2) * x**3 - (a + 3) * x**2 + 1, np.where(x < 2, a * x**3 - 5 * a * x**2 + 8 * a * x - 4 * a, 0.0))
    return w / w.sum(axis=1, keepdims=True)


def prepared(pixels: np.ndarray, size: int, mean: list[float], std: list[float]) -> np.ndarray:
    """Channels, size, size: the shorter side resized to ``size``, the centre cut out, values to 0..1 and normalised."""
    height, width, _ = pixels.shape
    short = min(height, width)
    h, w = max(size, height * size // short), max(size, width * size // short)
    x = np.einsum("ih,hwc,jw->ijc", _bicubic(h, height), pixels.astype(float), _bicubic(w, width), optimize=True)
    top, left = round((h - size) / 2), round((w - size) / 2)
    x = np.clip(np.rint(x[top : top + size, left : left + size]), 0, 255) / 255
    return ((x - np.array(mean)) / np.array(std)).transpose(2, 0, 1)


def image_header(data: Column) -> Column:
    """Struct of format, width and height, nulls where the bytes are no image; only the header is read."""

    @F.pandas_udf("format string, width int, height int")
    def headers(images: pd.Series) -> pd.DataFrame:
        rows = [header(d) or (None, None, None) for d in images]
        return pd.DataFrame(rows, columns=["format", "width", "height"]).astype({"width": "Int32", "height": "Int32"})

    return headers(data)


def decoded_image(data: Column) -> Column:
    """Struct of height, width, channels and the pixels' bytes in rows; nulls where the bytes can't be decoded."""

    @F.pandas_udf("height int, width int, channels int, data binary")
    def decoded(images: pd.Series) -> pd.DataFrame:
        rows = []
        for d in images:
            try:
                x = decode_png(d)
                rows.append((*x.shape, x.tobytes()))
            except Exception:  # bytes that are no image of this kind are a row of nulls
                rows.append((None, None, None, None))
        return pd.DataFrame(rows, columns=["height", "width", "channels", "data"]).astype(dict.fromkeys(("height", "width", "channels"), "Int32"))

    return decoded(data)


def image_tensor(data: Column, size: int, mean: list[float], std: list[float]) -> Column:
    """Flat channels x size x size values of an encoded image, ready for an encoder; null where it can't be decoded."""

    @F.pandas_udf("array<double>")
    def tensor(images: pd.Series) -> pd.Series:
        out = []
        for d in images:
            try:
                x = decode_png(d)
                out.append(prepared(x if x.shape[2] == 3 else np.repeat(x[:, :, :1], 3, axis=2), size, mean, std).ravel())
            except Exception:  # as in decoded_image
                out.append(None)
        return pd.Series(out, dtype=object)

    return tensor(data)


def pixel_values(rgb: Column, height: Column, width: Column, size: int, mean: list[float], std: list[float]) -> Column:
    """Flat 3 x size x size values of decoded pixels (three bytes each, red first), ready for an encoder; null of null ones.
    An image is held at a time."""

    @F.arrow_udf("array<double>")
    def values(data: pa.Array, h: pa.Array, w: pa.Array) -> pa.Array:
        flat, ends = [], [0]
        for d, y, x in zip(data, h.to_pylist(), w.to_pylist(), strict=True):
            if d.is_valid:
                flat.append(prepared(np.frombuffer(d.as_buffer(), np.uint8).reshape(y, x, 3), size, mean, std).ravel())
            ends.append(ends[-1] + (3 * size * size if d.is_valid else 0))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat) if flat else np.zeros(0)), mask=data.is_null())

    return values(rgb, height, width)
