"""Image kernels. Frames are rows with width, height, pix_fmt and one binary column per plane, or arrays of pixels.

Kernels are NumPy functions over a stack of equal frames (n, h, w, c); `map_planes` runs one over a DataFrame in Arrow
batches, so frames are worked on where they are read, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pixel format -> (bytes a pixel of the first plane, chroma shift x, chroma shift y, planes).
FORMATS = {
    "yuv420p": (1, 1, 1, 3), "yuv422p": (1, 1, 0, 3), "yuv444p": (1, 0, 0, 3), "nv12": (1, 1, 1, 2), "nv21": (1, 1, 1, 2),
    "rgb24": (3, 0, 0, 1), "bgr24": (3, 0, 0, 1), "rgba": (4, 0, 0, 1), "bgra": (4, 0, 0, 1), "argb": (4, 0, 0, 1), "gray8": (1, 0, 0, 1),
}


def plane_shape(fmt: str, width: int, height: int, plane: int) -> tuple[int, int, int]:
    """(rows, columns, bytes a pixel) of a plane; chroma sizes are rounded up."""
    size, sx, sy, planes = FORMATS[fmt]
    if plane >= planes:
        raise ValueError(f"{fmt} has {planes} planes")
    if plane == 0:
        return height, width, size
    return (height + (1 << sy) - 1) >> sy, (width + (1 << sx) - 1) >> sx, 2 if fmt in ("nv12", "nv21") else 1


def frame_size(fmt: str, width: int, height: int) -> int:
    return sum(int(np.prod(plane_shape(fmt, width, height, p))) for p in range(FORMATS[fmt][3]))


def half_up(x: np.ndarray) -> np.ndarray:
    """Rounded half away from zero."""
    return np.floor(np.abs(x) + 0.5) * np.sign(x)


def _bytes(x: np.ndarray) -> np.ndarray:
    return np.clip(x, 0, 255).astype(np.uint8)


def crop(x: np.ndarray, left: int, top: int, width: int, height: int) -> np.ndarray:
    if left < 0 or top < 0 or width < 1 or height < 1 or left + width > x.shape[2] or top + height > x.shape[1]:
        raise ValueError("crop outside of the frame")
    return x[:, top : top + height, left : left + width]


def crop_planes(planes: list[np.ndarray], fmt: str, left: int, top: int, width: int, height: int) -> list[np.ndarray]:
    """All planes of a frame, chroma offsets and sizes shifted by the subsampling."""
    _, sx, sy, n = FORMATS[fmt]
    out = [crop(planes[0], left, top, width, height)]
    for p in planes[1:n]:
        out.append(crop(p, left >> sx, top >> sy, (width + (1 << sx) - 1) >> sx, (height + (1 << sy) - 1) >> sy))
    return out


def pad(x: np.ndarray, width: int, height: int, left: int, top: int, color: tuple[int, int, int] = (0, 0, 0)) -> np.ndarray:
    """Packed frames on a canvas of one colour; gray takes its luma, a fourth channel is opaque."""
    n, h, w, c = x.shape
    if left < 0 or top < 0 or left + w > width or top + h > height:
        raise ValueError("the frame doesn't fit")
    r, g, b = color
    fill = [(77 * r + 150 * g + 29 * b) >> 8] if c == 1 else [r, g, b, 255][:c]
    out = np.empty((n, height, width, c), np.uint8)
    out[:] = np.array(fill, np.uint8)
    out[:, top : top + h, left : left + w] = x
    return out


def overlay(x: np.ndarray, image: np.ndarray, left: int, top: int, alpha: float = 1.0) -> np.ndarray:
    """An image (h, w, c) blended onto frames at (left, top); what lies outside is cut off."""
    alpha = min(max(alpha, 0.0), 1.0)
    out = x.copy()
    y0, x0 = max(top, 0), max(left, 0)
    y1, x1 = min(top + image.shape[0], x.shape[1]), min(left + image.shape[1], x.shape[2])
    if y0 < y1 and x0 < x1:
        fg = image[y0 - top : y1 - top, x0 - left : x1 - left].astype(np.float32)
        bg = x[:, y0:y1, x0:x1].astype(np.float32)
        out[:, y0:y1, x0:x1] = _bytes(half_up(fg * np.float32(alpha) + bg * np.float32(1 - alpha)))
    return out


def draw_text(x: np.ndarray, text: str, left: int, top: int, color: tuple[int, int, int], font: dict[str, list[int]], scale: int = 1) -> np.ndarray:
    """Text in a bitmap font (character -> five columns, lowest bit at the top, seven rows) onto rgb frames."""
    out, at = x.copy(), left
    for ch in text:
        if ord(ch) > 127:
            continue
        for col, bits in enumerate(font.get(ch, [])):
            for row in range(7):
                if bits >> row & 1:
                    y, xx = top + row * scale, at + col * scale
                    out[:, max(y, 0) : max(y + scale, 0), max(xx, 0) : max(xx + scale, 0)] = np.array(color, np.uint8)
        at += 6 * scale
    return out


def fade(x: np.ndarray, gain: np.ndarray | float) -> np.ndarray:
    """Every byte of every plane times the frame's gain."""
    g = np.broadcast_to(np.asarray(gain, np.float64), (len(x),)).reshape(-1, 1, 1, 1)
    return _bytes(half_up(x * g))


_Y, _CB, _CR = (77, 150, 29), (-43, -85, 128), (128, -107, -21)


def _weigh(x: np.ndarray, k: tuple[int, int, int]) -> np.ndarray:
    x = x.astype(np.int32)
    return (k[0] * x[..., 0] + k[1] * x[..., 1] + k[2] * x[..., 2] + 128) >> 8


def rgb_to_gray(x: np.ndarray) -> np.ndarray:
    return _bytes(_weigh(x, _Y))[..., None]


def rgb_to_yuv444(x: np.ndarray) -> list[np.ndarray]:
    return [_bytes(_weigh(x, _Y))[..., None], _bytes(_weigh(x, _CB) + 128)[..., None], _bytes(_weigh(x, _CR) + 128)[..., None]]


def rgb_to_yuv420(x: np.ndarray) -> list[np.ndarray]:
    """Full-range planes; chroma from the truncated means of 2x2 blocks, odd edges have none of their own."""
    n, h, w, _ = x.shape
    blocks = x[:, : h // 2 * 2, : w // 2 * 2].astype(np.int32).reshape(n, h // 2, 2, w // 2, 2, 3).sum((2, 4)) // 4
    return [_bytes(_weigh(x, _Y))[..., None], _bytes(_weigh(blocks, _CB) + 128)[..., None], _bytes(_weigh(blocks, _CR) + 128)[..., None]]


def yuv_to_rgb(planes: list[np.ndarray], sx: int = 1, sy: int = 1, compat: bool = False) -> np.ndarray:
    """Studio-range planes to rgb; every pixel takes the chroma of its own block.

    compat (of 2x2 blocks): as some libraries do it in groups of four columns, a group takes the mean of the row's first
    chroma value and that of the group's third column, the first group the first value alone; columns after the last
    whole group take their own.
    """
    y = planes[0][..., 0].astype(np.int32)
    h, w = y.shape[1:]
    up = [np.repeat(np.repeat(p[..., 0].astype(np.int32), 1 << sy, 1), 1 << sx, 2)[:, :h, :w] for p in planes[1:]]
    if compat:
        if (sx, sy) != (1, 1):
            raise ValueError("compat is for 4:2:0")
        third = np.arange(w) // 4 * 4 + 2
        for p in up:
            first = p[:, :, :1].copy()
            groups = w // 4 * 4
            mixed = np.where(third[:groups] > 2, (first + p[:, :, third[:groups]]) // 2, first)
            p[:, :, :groups] = mixed
    c, d, e = 298 * (y - 16), up[0] - 128, up[1] - 128
    return np.stack([_bytes((c + 409 * e + 128) >> 8), _bytes((c - 100 * d - 208 * e + 128) >> 8), _bytes((c + 516 * d + 128) >> 8)], -1)


def swap_rb(x: np.ndarray) -> np.ndarray:
    return x[..., [2, 1, 0, *range(3, x.shape[-1])]]


def add_alpha(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, np.full((*x.shape[:3], 1), 255, np.uint8)], -1)


def drop_alpha(x: np.ndarray) -> np.ndarray:
    return x[..., :3]


def gray_to_rgb(x: np.ndarray) -> np.ndarray:
    return np.repeat(x, 3, -1)


def split_nv12(uv: np.ndarray) -> list[np.ndarray]:
    """The interleaved chroma plane (n, h, w, 2) as two planes."""
    return [uv[..., :1], uv[..., 1:2]]


def join_nv12(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.concatenate([u, v], -1)


#: The conversions that exist.
CONVERSIONS = frozenset(
    {("yuv420p", "rgb24"), ("rgb24", "yuv420p"), ("rgb24", "gray8"), ("gray8", "rgb24"), ("rgba", "rgb24"), ("rgb24", "rgba"), ("bgr24", "rgb24"), ("rgb24", "bgr24"), ("nv12", "yuv420p"), ("yuv420p", "nv12"), ("rgb24", "yuv444p"), ("yuv444p", "rgb24")}
)


def is_supported(source: Column | str, target: Column | str) -> Column:
    """Whether frames of one pixel format can be converted to another, or are of it already."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (source, target))
    return (a == b) | F.concat_ws(">", a, b).isin(*sorted(f"{x}>{y}" for x, y in CONVERSIONS))


def convert_planes(planes: list[np.ndarray], source: str, target: str) -> list[np.ndarray]:
    if source == target:
        return planes
    if (source, target) not in CONVERSIONS:
        raise ValueError(f"{source} to {target} isn't supported")
    x = planes[0]
    return {
        ("yuv420p", "rgb24"): lambda: [yuv_to_rgb(planes)], ("rgb24", "yuv420p"): lambda: rgb_to_yuv420(x),
        ("rgb24", "gray8"): lambda: [rgb_to_gray(x)], ("gray8", "rgb24"): lambda: [gray_to_rgb(x)],
        ("rgba", "rgb24"): lambda: [drop_alpha(x)], ("rgb24", "rgba"): lambda: [add_alpha(x)],
        ("bgr24", "rgb24"): lambda: [swap_rb(x)], ("rgb24", "bgr24"): lambda: [swap_rb(x)],
        ("nv12", "yuv420p"): lambda: [x, *split_nv12(planes[1])], ("yuv420p", "nv12"): lambda: [x, join_nv12(*planes[1:])],
        ("rgb24", "yuv444p"): lambda: rgb_to_yuv444(x), ("yuv444p", "rgb24"): lambda: [yuv_to_rgb(planes, 0, 0)],
    }[source, target]()


def _places(target: int, source: int) -> tuple[np.ndarray, np.ndarray]:
    """Source index and its 8-bit fraction for each target index, centres aligned."""
    pos = (np.arange(target) * 2 + 1) * source * 128 // target - 128
    return pos >> 8, pos & 255


def scale_nearest(x: np.ndarray, width: int, height: int) -> np.ndarray:
    return x[:, np.arange(height) * x.shape[1] // height][:, :, np.arange(width) * x.shape[2] // width]


def scale_bilinear(x: np.ndarray, width: int, height: int) -> np.ndarray:
    def axis(target, source):
        pos = np.maximum((np.arange(target) * 2 + 1) * source * 128 // target - 128, 0)
        low = pos >> 8
        return np.minimum(low, source - 1), np.minimum(low + 1, source - 1), pos & 255

    (y0, y1, fy), (x0, x1, fx) = axis(height, x.shape[1]), axis(width, x.shape[2])
    s, fy, fx = x.astype(np.int64), fy[None, :, None, None], fx[None, None, :, None]
    rows = s[:, y0] * (256 - fy) + s[:, y1] * fy
    return ((rows[:, :, x0] * (256 - fx) + rows[:, :, x1] * fx + 32768) >> 16).astype(np.uint8)


def _scale_kernel(x: np.ndarray, width: int, height: int, taps: np.ndarray, weight: Callable) -> np.ndarray:
    """Separable integer weights (of 256) on the taps around each place, normalised, rounded."""

    def axis(target, source):
        at, frac = _places(target, source)
        return np.clip(at[:, None] + taps, 0, source - 1), weight(taps[None] * 256 - frac[:, None])

    (yi, wy), (xi, wx) = axis(height, x.shape[1]), axis(width, x.shape[2])
    total, norm = np.zeros((len(x), height, width, x.shape[3]), np.int64), np.zeros((height, width), np.int64)
    for a in range(len(taps)):
        for b in range(len(taps)):
            w = (wy[:, a][:, None] * wx[:, b][None]) >> 8
            total += x[:, yi[:, a]][:, :, xi[:, b]].astype(np.int64) * w[None, :, :, None]
            norm += w
    norm = norm[None, :, :, None]
    return _bytes(np.where(norm > 0, (total + norm // 2) // np.maximum(norm, 1), 0))


def scale_lanczos(x: np.ndarray, width: int, height: int, a: int = 3) -> np.ndarray:
    def weight(t):
        t = np.abs(t)
        v = np.pi * np.maximum(t, 1) / 256
        w = np.trunc(np.sin(v) / v * np.sin(v / a) / (v / a) * 256).astype(np.int64)
        return np.where(t == 0, 256, np.where(t >= a * 256, 0, w))

    return _scale_kernel(x, width, height, np.arange(1 - a, a + 1), weight)


def scale_bicubic(x: np.ndarray, width: int, height: int, compat: bool = False) -> np.ndarray:
    """Catmull-Rom weights; compat: those of a known integer form, in which the middle term counts twice."""

    def weight(t):
        if compat:
            t = np.abs(t)
            t2 = t * t >> 8
            t3 = t2 * t >> 8
            double = np.where(t <= 256, 3 * t3 - 10 * t2 + 512, np.where(t <= 512, -t3 + 5 * t2 - 8 * t + 1024, 0))
            return np.sign(double) * (np.abs(double) // 2)  # toward zero
        t = np.abs(t) / 256
        w = np.where(t < 1, 1.5 * t**3 - 2.5 * t**2 + 1, np.where(t < 2, -0.5 * t**3 + 2.5 * t**2 - 4 * t + 2, 0))
        return half_up(w * 256).astype(np.int64)

    return _scale_kernel(x, width, height, np.arange(-1, 3), weight)


def scale_area(x: np.ndarray, width: int, height: int) -> np.ndarray:
    """Rounded box means; bilinear if either axis grows."""
    h, w = x.shape[1:3]
    if width > w or height > h:
        return scale_bilinear(x, width, height)
    sums = np.pad(x.astype(np.int64).cumsum(1).cumsum(2), ((0, 0), (1, 0), (1, 0), (0, 0)))
    y, xx = np.arange(height + 1) * h // height, np.arange(width + 1) * w // width
    box = sums[:, y[1:]][:, :, xx[1:]] - sums[:, y[:-1]][:, :, xx[1:]] - sums[:, y[1:]][:, :, xx[:-1]] + sums[:, y[:-1]][:, :, xx[:-1]]
    count = (np.diff(y)[:, None] * np.diff(xx)[None])[None, :, :, None]
    return ((box + count // 2) // count).astype(np.uint8)


SCALERS = {"nearest": scale_nearest, "bilinear": scale_bilinear, "bicubic": scale_bicubic, "lanczos": scale_lanczos, "area": scale_area}


def scale_planes(planes: list[np.ndarray], fmt: str, width: int, height: int, method: str = "bilinear") -> list[np.ndarray]:
    """All planes of a frame, chroma to its own size."""
    out = []
    for k, p in enumerate(planes):
        h, w, _ = plane_shape(fmt, width, height, k)
        out.append(SCALERS[method](p, w, h))
    return out


def scale_and_convert(planes: list[np.ndarray], source: str, width: int, height: int, target: str, method: str = "bilinear") -> list[np.ndarray]:
    """Scaled in the source format first, then converted."""
    return convert_planes(scale_planes(planes, source, width, height, method), source, target)


def map_pixels(frames: DataFrame, column: str, shape: tuple[int, int, int], kernel: Callable[[np.ndarray], np.ndarray], out: str | None = None) -> DataFrame:
    """Frames whose column is an array of pixel values (h, w, c flattened, all of one shape) through a kernel.

    The result column is an array<int> of the kernel's values; other columns stay. Null frames stay null.
    """
    names, out = frames.columns, out or column
    at = names.index(column)
    kept = [n for n in names if n != out]

    def run(batches):
        for b in batches:
            cells = b.column(at)
            full = cells.is_valid().to_numpy(zero_copy_only=False)
            n = int(full.sum())
            y = kernel(cells.flatten().to_numpy().astype(np.uint8).reshape(n, *shape)) if n else np.empty((0, 1), np.uint8)
            flat, size = y.reshape(-1).astype(np.int32), y.size // n if n else 0
            ends = np.r_[0, np.cumsum(full * size)].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends, mask=np.append(~full, False)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*(b.column(names.index(c)) for c in kept), lists], names=[*kept, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.schema if f.name != out)
    return frames.mapInArrow(run, f"{fields}, `{out}` array<int>")


def map_planes(frames: DataFrame, fmt: str, kernel: Callable[[list[np.ndarray]], list[np.ndarray]], planes: str = "planes") -> DataFrame:
    """Frames (width, height, planes array<binary>, ...) of one format through a kernel on their planes.

    Width and height become those of the kernel's first plane. Frames are worked on one at a time, so a batch needs no
    more memory than it has; rows whose planes don't have the sizes of the format raise an error.
    """
    names, schema = frames.columns, frames.schema
    at, w_at, h_at = (names.index(n) for n in (planes, "width", "height"))

    def run(batches):
        for b in batches:
            cols = [b.column(i).to_pylist() if i in (at, w_at, h_at) else b.column(i) for i in range(len(names))]
            for i, (data, w, h) in enumerate(zip(cols[at], cols[w_at], cols[h_at], strict=True)):
                if data is None:
                    continue
                stack = [np.frombuffer(p, np.uint8).reshape(1, *plane_shape(fmt, w, h, k)) for k, p in enumerate(data)]
                out = kernel(stack)
                cols[at][i], cols[w_at][i], cols[h_at][i] = [p.tobytes() for p in out], out[0].shape[2], out[0].shape[1]
            cols = [pa.array(c, b.column(i).type) if isinstance(c, list) else c for i, c in enumerate(cols)]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return frames.mapInArrow(run, schema)


def explode_pixels(frames: DataFrame, column: str, width: int, channels: int = 1, name: str = "v") -> DataFrame:
    """One row for each value: frame_no, y, x[, c], v."""
    i = F.col("_i")
    rows = frames.select("frame_no", F.posexplode(column).alias("_i", name))
    cols = ["frame_no", F.floor(i / (width * channels)).cast("int").alias("y"), (F.floor(i / channels) % width).cast("int").alias("x")]
    return rows.select(*cols, *([(i % channels).alias("c")] if channels > 1 else []), name)


def explode_planes(frames: DataFrame, column: str, sizes: list[tuple[int, int]], name: str = "v") -> DataFrame:
    """One row for each value: frame_no, y, x, v, plane; the column holds planes of (height, width) one after the other."""
    i, at = F.col("_i"), 0
    rows = frames.select("frame_no", F.posexplode(column).alias("_i", name))
    y = x = plane = F.lit(None).cast("int")
    for k, (h, w) in reversed(list(enumerate(sizes))):
        at = sum(a * b for a, b in sizes[:k])
        here = i >= at
        place = i - at
        y = F.when(here & plane.isNull(), F.floor(place / w).cast("int")).otherwise(y)
        x = F.when(here & plane.isNull(), place % w).otherwise(x)
        plane = F.when(here & plane.isNull(), F.lit(k)).otherwise(plane)
    return rows.select("frame_no", y.alias("y"), x.cast("int").alias("x"), name, plane.alias("plane"))
