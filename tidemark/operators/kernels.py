"""Matrices and images: JVM array expressions where they suffice, numpy kernels behind Arrow UDFs elsewhere."""

from __future__ import annotations

import json
import struct
import zlib
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reshape(v: Column, cols: int) -> Column:
    """Flat array to rows of ``cols`` values (a rest shorter than a row is dropped)."""
    n = F.floor(F.size(v) / cols).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(v, i * cols + 1, F.lit(cols)))).otherwise(F.array().cast("array<array<double>>"))


def crop(m: Column, x: int, y: int, width: int, height: int) -> Column:
    """Window of a matrix, clamped at its edges."""
    return F.transform(F.slice(m, y + 1, height), lambda r: F.slice(r, x + 1, width))


def threshold(m: Column, least: float, high: float = 255.0, low: float = 0.0) -> Column:
    return F.transform(m, lambda r: F.transform(r, lambda v: F.when(v >= least, F.lit(high)).otherwise(F.lit(low))))


def pad_edge(m: Column, rows: int, cols: int) -> Column:
    """Repeats the border values outward; null for an empty matrix."""
    wide = F.transform(m, lambda r: F.concat(F.array_repeat(F.try_element_at(r, F.lit(1)), cols), r, F.array_repeat(F.try_element_at(r, F.lit(-1)), cols)))
    return F.when(F.size(m) > 0, F.concat(F.array_repeat(F.try_element_at(wide, F.lit(1)), rows), wide, F.array_repeat(F.try_element_at(wide, F.lit(-1)), rows)))


def pad_zero(m: Column, rows: int, cols: int) -> Column:
    """Zeros to the right and below."""
    zero = F.lit(0.0)
    wide = F.transform(m, lambda r: F.concat(r, F.array_repeat(zero, cols)))
    return F.concat(wide, F.array_repeat(F.array_repeat(zero, F.size(F.element_at(wide, 1))), rows))


def resize_nearest(m: Column, width: int, height: int) -> Column:
    """Nearest value up or left of each place; null for an empty matrix."""
    pick = lambda a, i, n: F.try_element_at(a, (F.floor(i * F.size(a) / n) + 1).cast("int"))
    cols = lambda r: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: pick(r, j, width))
    return F.when(F.size(m) > 0, F.transform(F.sequence(F.lit(0), F.lit(height - 1)), lambda i: cols(pick(m, i, height))))


def _batches(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, stack of equally sized matrices) of a column of matrices; nulls and ragged ones are left out.

    The values are read as one flat buffer; no list is built per row."""
    outer = column.offsets.to_numpy().astype(np.int64)
    rows = column.values
    inner = rows.offsets.to_numpy().astype(np.int64) if len(rows) else np.zeros(1, np.int64)
    flat = rows.values.to_numpy(zero_copy_only=False) if len(rows) else np.zeros(0)
    height = np.diff(outer)
    first = inner[np.minimum(outer[:-1], len(inner) - 1)]
    last = inner[np.minimum(outer[1:], len(inner) - 1)]
    width = np.where(height > 0, (last - first) // np.maximum(height, 1), 0)
    wide = np.diff(inner)
    good = np.array([h > 0 and v and (wide[i : i + h] == w).all() for i, h, w, v in zip(outer[:-1], height, width, column.is_valid().to_numpy(zero_copy_only=False))], bool)
    out = []
    for h, w in {(int(h), int(w)) for h, w in zip(height[good], width[good])}:
        at = np.flatnonzero(good & (height == h) & (width == w))
        out.append((at, flat[first[at][:, None] + np.arange(h * w)].astype(float).reshape(len(at), h, w)))
    return out


def _matrices(parts: list[tuple[np.ndarray, np.ndarray]], n: int) -> pa.Array:
    """A column of n matrices from stacks with their row numbers; rows without one are null."""
    height, width, flat = np.zeros(n, np.int64), np.zeros(n, np.int64), [None] * len(parts)
    order = np.empty((n, 2), np.int64)
    known = np.zeros(n, bool)
    for k, (at, m) in enumerate(parts):
        height[at], width[at], known[at] = m.shape[1], m.shape[2], True
        order[at, 0], order[at, 1] = k, np.arange(len(at))
        flat[k] = m
    if len(parts) == 1 and known.all():
        values = flat[0][order[:, 1]].reshape(-1)
    else:
        values = np.concatenate([flat[k][j].reshape(-1) for (k, j), ok in zip(order, known) if ok] or [np.zeros(0)])
    inner = np.r_[0, np.cumsum(np.repeat(width, height))].astype(np.int32)
    outer = pa.array(np.r_[0, np.cumsum(height)].astype(np.int32), mask=np.r_[~known, False])
    return pa.ListArray.from_arrays(outer, pa.ListArray.from_arrays(pa.array(inner), pa.array(values, pa.float64())))


def on_matrices(m: Column, f) -> Column:
    """Applies ``f`` (stack of matrices -> stack of matrices) to a column of matrices, batch by batch."""
    @F.arrow_udf("array<array<double>>")
    def run(c: pa.Array) -> pa.Array:
        return _matrices([(at, f(x)) for at, x in _batches(c)], len(c))

    return run(m)


def correlate(channels: np.ndarray, kernel: np.ndarray, stride: tuple[int, int] = (1, 1)) -> np.ndarray:
    """Valid cross-correlation summed over channels: (c, h, w) with (c, kh, kw)."""
    win = np.lib.stride_tricks.sliding_window_view(channels, kernel.shape[1:], (1, 2))[:, :: stride[0], :: stride[1]]
    return np.einsum("chwkl,ckl->hw", win, kernel)


def fft_convolve(channels: np.ndarray, kernel: np.ndarray, stride: tuple[int, int] = (1, 1)) -> np.ndarray:
    """True convolution by FFT over the full size, cropped to the input's top left corner."""
    size = [a + b - 1 for a, b in zip(channels.shape[1:], kernel.shape[1:])]
    full = np.fft.irfft2((np.fft.rfft2(channels, size) * np.fft.rfft2(kernel, size)).sum(0), size)
    return full[: channels.shape[1] : stride[0], : channels.shape[2] : stride[1]]


def kernel_gradient(channel: np.ndarray, grad: np.ndarray, size: tuple[int, int], stride: tuple[int, int] = (1, 1), pad: tuple[int, int] = (0, 0)) -> np.ndarray:
    """Sum of grad[h, w] * input over the places each kernel cell saw: a correlation with the spread gradient as kernel."""
    reach = [(g - 1) * s + 1 for g, s in zip(grad.shape, stride)]
    wide = np.pad(channel, [(p, max(0, k + r - 1 - n - p)) for p, k, r, n in zip(pad, size, reach, channel.shape)])
    win = np.lib.stride_tricks.sliding_window_view(wide, reach)[: size[0], : size[1], :: stride[0], :: stride[1]]
    return np.einsum("mnhw,hw->mn", win, grad)


def convolve(m: Column, kernel: np.ndarray, method: str = "valid", stride: tuple[int, int] = (1, 1), pad: int = 0) -> Column:
    """Single-channel convolution of a matrix column: 'valid' (correlation, edge-padded by ``pad``) or 'fft'."""
    def run(x: np.ndarray) -> np.ndarray:
        x = np.pad(x, ((0, 0), (pad, pad), (pad, pad)), "edge") if pad else x
        if method == "valid":
            win = np.lib.stride_tricks.sliding_window_view(x, kernel.shape, (1, 2))[:, :: stride[0], :: stride[1]]
            return np.einsum("nhwkl,kl->nhw", win, kernel)
        size = [a + b - 1 for a, b in zip(x.shape[1:], kernel.shape)]
        full = np.fft.irfft2(np.fft.rfft2(x, size) * np.fft.rfft2(kernel, size), size)
        return full[:, : x.shape[1] : stride[0], : x.shape[2] : stride[1]]

    return on_matrices(m, run)


@dataclass
class ConvLayer:
    """Convolution layer with He-normal weights of a seed; ``predict`` pads by edge values unless method is 'fft'."""

    channels: int
    features: int
    kernel: tuple[int, int]
    stride: tuple[int, int] = (1, 1)
    pad: int = 0
    method: str = "valid"
    seed: int = 0
    weights: np.ndarray = field(init=False)

    def __post_init__(self):
        fan = self.channels * self.kernel[0] * self.kernel[1]
        self.weights = np.random.default_rng(self.seed).normal(0, np.sqrt(2 / fan), (self.features, self.channels, *self.kernel))

    def weight_count(self) -> int:
        return self.weights.size

    def output_size(self, h: int, w: int) -> tuple[int, int]:
        """Declared size, without the usual + 1."""
        return (h + 2 * self.pad - self.kernel[0]) // self.stride[0], (w + 2 * self.pad - self.kernel[1]) // self.stride[1]

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.method == "fft":
            return np.stack([fft_convolve(x, k, self.stride) for k in self.weights])
        x = np.pad(x, ((0, 0), (self.pad, self.pad), (self.pad, self.pad)), "edge")
        return np.stack([correlate(x, k, self.stride) for k in self.weights])

    def save(self, path: str) -> None:
        """Settings and weights as readable JSON."""
        names = ("channels", "features", "kernel", "stride", "pad", "method", "seed")
        Path(path).write_text(json.dumps({n: getattr(self, n) for n in names} | {"weights": self.weights.tolist()}, indent=1))

    @classmethod
    def read(cls, path: str) -> ConvLayer:
        c = json.loads(Path(path).read_text())
        weights = np.array(c.pop("weights"))
        layer = cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in c.items()})
        layer.weights = weights
        return layer

    def gradients(self, x: np.ndarray, grad: np.ndarray) -> np.ndarray:
        return np.stack([np.stack([kernel_gradient(c, g, self.kernel, self.stride, (self.pad, self.pad)) for c in x]) for g in grad])


def lanczos(x: np.ndarray, a: int) -> np.ndarray:
    return np.where(np.abs(x) < a, np.sinc(x) * np.sinc(x / a), 0.0)


def resize_lanczos(img: np.ndarray, width: int, height: int, window: int = 3) -> np.ndarray:
    """(h, w, c) bytes resampled; weights are normalised inside the image, values truncated to bytes."""
    def side(n_out: int, n_in: int) -> np.ndarray:
        at = np.arange(n_out) * n_in / n_out
        src = np.floor(at)[:, None].astype(int) + np.arange(-(window - 1), window + 1)
        w = lanczos(at[:, None] - src, window) * ((src >= 0) & (src < n_in))
        out = np.zeros((n_out, n_in))
        np.add.at(out, (np.arange(n_out)[:, None], np.clip(src, 0, n_in - 1)), w)
        return out

    wy, wx = side(height, img.shape[0]), side(width, img.shape[1])
    total = np.outer(wy.sum(1), wx.sum(1))
    v = np.einsum("yh,hwc,xw->yxc", wy, img.astype(float), wx) / np.where(total != 0, total, 1)[:, :, None]
    return np.clip(np.where(total[:, :, None] != 0, v, 0), 0, 255).astype(np.uint8)


def quantise(img: np.ndarray, step: int = 8) -> np.ndarray:
    return img // step * step


def range_to_white(img: np.ndarray, lo: tuple[int, ...], hi: tuple[int, ...]) -> np.ndarray:
    hit = np.all((img[..., :3] >= lo) & (img[..., :3] <= hi), axis=-1)
    return np.where(hit[..., None], np.uint8(255), img)


def binarise(img: np.ndarray, least: int = 230) -> np.ndarray:
    return np.where(np.all(img[..., :3] >= least, axis=-1), np.uint8(255), np.uint8(0))


def white_count(img: np.ndarray, least: int = 250, mode: str = "pixel") -> int:
    """'pixel' counts white pixels; 'bytes' counts overlapping windows of three bytes."""
    if mode == "bytes":
        b = img.reshape(-1) >= least
        return int((b[:-2] & b[1:-1] & b[2:]).sum())
    return int(np.all(img[..., :3] >= least, axis=-1).sum())


def segments(white: np.ndarray, window: int, height: int, skip: int = 250, least: float = 0.03) -> list[int]:
    """Starts of the strip's segments: the last rise of the white count in a sliding window before it falls."""
    count = np.convolve(white, np.ones(window, int), "valid") if len(white) >= window else np.zeros(0, int)
    out, x, best, last, rising = [], 0, 0, count[0] if len(count) else 0, True
    while x < len(count) - 1:
        now = count[x]
        if now >= last:
            best, rising = x, True
        if now < last and rising:
            if count[best] <= least * window * height:
                x += 1
                continue
            out.append(best)
            rising = False
            x += skip
        x += 1
        last = now
    return out


PNG_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def png_decode(data: bytes) -> np.ndarray:
    """(h, w, c) bytes of a 1 to 16 bit PNG, interlaced or not; palettes are resolved, 16 bit keeps the high byte."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, idat, palette, head = 8, b"", None, None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            idat += body
        at += 12 + n
    w, h, depth, color, _, _, interlace = head
    c = PNG_CHANNELS[color]
    data = np.frombuffer(zlib.decompress(idat), np.uint8)
    if interlace:
        img, at = np.zeros((h, w, c), np.uint8), 0
        for y0, x0, dy, dx in ADAM7:
            ph, pw = len(range(y0, h, dy)), len(range(x0, w, dx))
            if ph and pw:
                n = ph * ((pw * c * depth + 7) // 8 + 1)
                img[y0::dy, x0::dx] = _png_pixels(data[at : at + n], pw, ph, c, depth, color)
                at += n
    else:
        img = _png_pixels(data, w, h, c, depth, color)
    return palette[img[..., 0]] if color == 3 else img


#: Fixed values of the interlaced format: first row, first column, row step, column step of each pass.
ADAM7 = ((0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1))


def _unfilter(raw: np.ndarray, filters: np.ndarray, bpp: int) -> np.ndarray:
    """Undoes the row filters. A pixel needs its left, upper and upper left neighbours, so all pixels of one antidiagonal
    are done at once."""
    h, n = raw.shape
    w = n // bpp
    out = np.zeros((h + 1, w + 1, bpp), np.int32)
    src, kinds = raw.reshape(h, w, bpp).astype(np.int32), filters[:, None]
    for d in range(h + w - 1):
        y = np.arange(max(0, d - w + 1), min(h, d + 1))
        x = d - y
        a, b, c, k = out[y + 1, x], out[y, x + 1], out[y, x], kinds[y]
        e = a + b - c
        far = [np.abs(e - v) for v in (a, b, c)]
        paeth = np.where((far[0] <= far[1]) & (far[0] <= far[2]), a, np.where(far[1] <= far[2], b, c))
        guess = np.select([k == 1, k == 2, k == 3, k == 4], [a, b, (a + b) // 2, paeth], 0)
        out[y + 1, x + 1] = (src[y, x] + guess) & 255
    return out[1:, 1:].reshape(h, n).astype(np.uint8)


def _png_pixels(data: np.ndarray, w: int, h: int, c: int, depth: int, color: int) -> np.ndarray:
    row_bytes, bpp = (w * c * depth + 7) // 8, max(1, c * depth // 8)
    rows = data[: h * (row_bytes + 1)].reshape(h, row_bytes + 1)
    out = rows[:, 1:] if not rows[:, 0].any() else _unfilter(rows[:, 1:], rows[:, 0], bpp)
    if depth < 8:
        bits = np.unpackbits(out, axis=1).reshape(h, -1, depth)
        v = (bits * (1 << np.arange(depth)[::-1])).sum(2)[:, : w * c]
        out = (v if color == 3 else v * 255 // ((1 << depth) - 1)).astype(np.uint8)
    elif depth == 16:
        out = out[:, ::2]
    return out.reshape(h, w, c)


def png_meta(data: bytes) -> dict:
    """Size, depth, colour type, interlacing and, where they are given, gamma, chromaticities and pixels per metre."""
    meta, at = {}, 8
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            meta |= dict(zip(("width", "height", "depth", "color", "compression", "filter", "interlace"), struct.unpack(">IIBBBBB", body)))
        elif kind == b"gAMA":
            meta["gamma"] = struct.unpack(">I", body)[0] / 100_000
        elif kind == b"cHRM":
            meta["chroma"] = tuple(v / 100_000 for v in struct.unpack(">8I", body))
        elif kind == b"pHYs":
            x, y, unit = struct.unpack(">IIB", body)
            meta["pixels_per_metre"] = (x, y) if unit == 1 else None
        at += 12 + n
    return meta


def png_encode(img: np.ndarray) -> bytes:
    h, w, c = img.shape
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    rows = np.concatenate([np.zeros((h, 1), np.uint8), img.reshape(h, w * c).astype(np.uint8)], 1)
    color = {v: k for k, v in PNG_CHANNELS.items() if k != 3}[c]
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, color, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def lstmf_header(data: bytes) -> tuple[str, str]:
    """(path, text) of two length-prefixed little-endian strings."""
    n = struct.unpack_from("<I", data)[0]
    m = struct.unpack_from("<I", data, 4 + n)[0]
    return data[4 : 4 + n].decode(), data[8 + n : 8 + n + m].decode()


def images(df: DataFrame, content: str, keep: list[str], transform) -> DataFrame:
    """Decodes PNG bytes, applies ``transform`` (array -> array) and encodes again; unreadable images give null."""
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + ", width int, height int, png binary"

    def run(batches):
        for b in batches:
            rows = []
            for data in b[content]:
                try:
                    img = transform(png_decode(bytes(data)))
                    img = img[..., None] if img.ndim == 2 else img
                    rows.append((img.shape[1], img.shape[0], png_encode(img)))
                except (ValueError, TypeError, KeyError, zlib.error, struct.error):
                    rows.append((None, None, None))
            w, h, p = zip(*rows) if rows else ((), (), ())
            yield b[keep].assign(width=pd.array(w, "Int32"), height=pd.array(h, "Int32"), png=list(p))

    return df.select(*keep, content).mapInPandas(run, schema)


def text_provider(df: DataFrame, content: str, key: str, recognise) -> DataFrame:
    """Pluggable recognition: ``recognise(bytes) -> str`` per row in batches; the default provider reads extracted text."""
    def run(batches):
        for b in batches:
            yield pd.DataFrame({key: b[key], "text": [recognise(bytes(x)) if x is not None else None for x in b[content]]})

    return df.select(key, content).mapInPandas(run, f"`{key}` {df.schema[key].dataType.simpleString()}, text string")
