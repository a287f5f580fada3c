"""Image profiling: features, page mode, and an enhancement plan, as Column expressions.

Pixels are arrays of ints in row order. Sums are integer, so results don't depend on order.
Differences of neighbouring gray values wrap modulo 256 (``signed=True`` takes them as they are);
an image one pixel high or wide has no such difference: its sharpness is NaN, which no rule
counts as sharp or blurred. Nulls give nulls.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, StructField, StructType

from ..functions.text import bind

NAN = float("nan")
#: Factor of the sharpening step.
SHARPEN = 1.5
#: Sums of a block, so that it stays in the processor's cache.
CELLS = 40_000
#: Bytes of pixels that go back to Spark at once.
MOST_BYTES = 8 << 20
FEATURES = ("brightness", "contrast", "sharpness", "has_color", "size_ratio")


def total(values: Column, of=lambda x: x) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + of(x).cast("long"))


def clamp(x: Column, top: float = 1.0) -> Column:
    """``min(x, top)`` that keeps NaN."""
    return F.when(F.isnan(x), x).otherwise(F.least(x, F.lit(top)))


def channel(px: Column, channels: Column | int, k: int) -> Column:
    """The k-th channel of interleaved pixels."""
    return F.filter(px, lambda _, i: i % channels == k)


def gray(r: Column, g: Column, b: Column) -> Column:
    """Luma with weights 299, 587, 114 of 1000, rounded to the nearest, halves up."""
    return F.zip_with(F.zip_with(r, g, lambda x, y: x * 299 + y * 587), b, lambda s, z: F.floor((s + z * 114 + 500) / 1000).cast("int"))


def mean(values: Column) -> Column:
    return total(values) / F.size(values)


def deviation(values: Column) -> Column:
    """Population standard deviation from integer sums."""
    n, s = F.size(values), total(values).cast("double")
    return F.sqrt(F.greatest((total(values, lambda x: x * x) - s * s / n) / n, F.lit(0.0)))


def mean_step(values: Column, width: Column, height: Column, signed: bool = False) -> Column:
    """Mean neighbour difference down plus mean neighbour difference across."""
    step = (lambda a, b: F.abs(b - a)) if signed else (lambda a, b: F.pmod(b - a, F.lit(256)))

    def of(v: Column) -> Column:
        down = total(F.transform(v, lambda x, i: F.coalesce(step(x, F.get(v, (i + width).cast("int"))), F.lit(0))))
        across = total(F.transform(v, lambda x, i: F.when((i + 1) % width == 0, 0).otherwise(F.coalesce(step(x, F.get(v, i + 1)), F.lit(0)))))
        return down / ((height - 1) * width) + across / (height * (width - 1))

    return F.when((width < 2) | (height < 2), NAN).otherwise(bind(values, of))


def size_ratio(width: Column, height: Column) -> Column:
    return F.least(F.when(height > 0, width / height).otherwise(1.0), F.lit(5.0)) / 5.0


def features(r: Column, g: Column, b: Column, width: Column, height: Column, signed: bool = False) -> Column:
    """The feature struct of an RGB image given as three channel arrays."""
    means = [mean(c) for c in (r, g, b)]
    centre = (means[0] + means[1] + means[2]) / 3
    spread = F.sqrt(sum((m - centre) * (m - centre) for m in means[1:]) / 3 + (means[0] - centre) * (means[0] - centre) / 3)
    return F.struct(
        (centre / 255).alias("brightness"),
        F.least((deviation(r) + deviation(g) + deviation(b)) / 3 / 60, F.lit(1.0)).alias("contrast"),
        clamp(mean_step(gray(r, g, b), width, height, signed) / 30).alias("sharpness"),
        F.when(spread > 10, 1).otherwise(0).alias("has_color"),
        size_ratio(width, height).alias("size_ratio"),
    )


def page_mode(width: Column, height: Column) -> Column:
    """7: one line; 11: sparse text; 6: a block (narrow columns too)."""
    aspect = F.when(height > 0, width / height).otherwise(1.0)
    return F.when((aspect > 4) & (height < 100), 7).when((width < 300) | (height < 100), 11).otherwise(6)


def inverted(brightness: Column) -> Column:
    return brightness * 255 < 100


def upscale(width: Column, height: Column) -> Column:
    """struct<factor, width, height>; factor 1 leaves the size."""
    small = (height < 100) | (width < 300)
    factor = F.when(small, F.greatest(F.lit(2.0), F.lit(100.0) / height, F.lit(300.0) / width)).otherwise(1.0)
    return F.struct(factor.alias("factor"), (width * factor).cast("int").alias("width"), (height * factor).cast("int").alias("height"))


def enhance_plan(brightness: Column, contrast: Column, width: Column, height: Column) -> Column:
    """Steps as array<struct<op, factor>>; brightness and contrast are those measured after upscaling."""
    step = lambda op, factor: F.struct(F.lit(op).alias("op"), (factor if isinstance(factor, Column) else F.lit(factor)).alias("factor"))
    factor = upscale(width, height)["factor"]
    bright = brightness * 255
    steps = F.array(
        F.when(factor > 1, step("upscale", factor)), F.when(inverted(brightness), step("invert", 1.0)), F.when(contrast * 128 < 40, step("contrast", 1.8)),
        step("sharpness", SHARPEN), F.when(bright < 80, step("brightness", 1.4)), F.when(bright > 200, step("brightness", 0.8)),
    )
    return F.filter(steps, lambda s: s.isNotNull())


@lru_cache(maxsize=64)
def lanczos_weights(n: int, m: int) -> np.ndarray:
    """(m, n), not to be changed: how m places are made of n, by a Lanczos window of three lobes, normalised at the edges."""
    scale = max(1.0, n / m)
    centre = (np.arange(m) + 0.5) * n / m
    x = (np.arange(n)[None] + 0.5 - centre[:, None]) / scale
    w = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)
    return w / w.sum(axis=1, keepdims=True)


def weighted(weights: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Weighted sums of lines in whole values, halves up.

    BLAS adds in an order of its own; sums that close to a half are added term by term, so that no
    result depends on it.
    """
    (m, n), k = weights.shape, lines.shape[1]
    out, step = np.empty((m, k), np.uint8), max(1, CELLS // max(1, k))
    for a in range(0, m, step):
        part = weights[a : a + step]
        sums = part @ lines
        sums += 0.5
        whole = np.floor(sums)
        sums -= whole
        if sums.min(initial=1) < 1e-8 or sums.max(initial=0) > 1 - 1e-8:
            at, x = np.divmod(np.flatnonzero(np.abs(sums - 0.5) > 0.5 - 1e-8), k)
            total = np.zeros(len(at))
            for i in range(n):
                total += part[at, i] * lines[i, x]
            whole[at, x] = np.floor(total + 0.5)
        out[a : a + step] = np.clip(whole, 0, 255, out=whole)
    return out


def resized(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """An HxWxC image scaled across, then down, rounded to whole values after each."""
    h, w, c = pixels.shape
    across = weighted(lanczos_weights(w, width), pixels.transpose(1, 0, 2).reshape(w, h * c).astype(np.float64))
    lines = across.reshape(width, h, c).transpose(1, 0, 2).reshape(h, width * c).astype(np.float64)
    return weighted(lanczos_weights(h, height), lines).reshape(height, width, c)


def scale_of(width: int, height: int) -> float:
    """The factor by which small images are scaled up; 1 for others."""
    return max(2.0, 100 / height, 300 / width) if height < 100 or width < 300 else 1.0


def channel_sums(pixels: np.ndarray, power: int = 1) -> list[int]:
    h, w, c = pixels.shape
    values = pixels.reshape(h, w * c).astype(np.float64)
    if power == 2:
        values *= values
    return [int(s) for s in (np.ones(h) @ values).reshape(w, c).sum(axis=0)]


def tone(pixels: np.ndarray) -> tuple[float, float]:
    """Brightness and contrast of an HxWxC uint8 image from integer sums, as ``profile`` has them."""
    n, c = pixels.shape[0] * pixels.shape[1], min(pixels.shape[2], 3)
    sums, squares = (channel_sums(pixels, power)[:c] for power in (1, 2))
    spread = [math.sqrt(max(n * q - s * s, 0)) / n for s, q in zip(sums, squares, strict=True)]
    return sum(s / n for s in sums) / c / 255, min(sum(spread) / c / 60, 1.0)


def profile(pixels: np.ndarray) -> tuple[float, float, float, int, float]:
    """The features of an HxWxC uint8 image (one, three or four channels) in one pass of numpy."""
    rgb = np.repeat(pixels, 3, axis=2) if pixels.shape[2] == 1 else pixels[:, :, :3]
    h, w = rgb.shape[:2]
    values = rgb.astype(np.int64)
    means = values.mean(axis=(0, 1))
    gray = ((values @ np.array([299, 587, 114]) + 500) // 1000).astype(np.uint8)
    steps = [np.diff(gray, axis=k).mean() if gray.shape[k] > 1 and min(h, w) > 1 else NAN for k in (0, 1)]
    sharp = sum(steps) / 30
    return float(means.mean() / 255), float(min(values.std(axis=(0, 1)).mean() / 60, 1)), float(sharp if sharp != sharp else min(sharp, 1)), int(means.std() > 10), min(w / h, 5) / 5


@F.pandas_udf(StructType([StructField(n, IntegerType() if n == "has_color" else DoubleType()) for n in FEATURES]))
def _profiled(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
    for data, width, height, channels, enlarge in batches:
        out = []
        for d, w, h, c, large in zip(data, width, height, channels, enlarge, strict=True):
            if d is None or w < 1 or h < 1 or c not in (1, 3, 4):
                out.append((None,) * len(FEATURES))
                continue
            image = np.frombuffer(d, np.uint8).reshape(h, w, c)
            out.append(profile(enlarged(image) if large else image))
        yield pd.DataFrame(out, columns=list(FEATURES))


def profiled(data: Column | str, width: Column | str, height: Column | str, channels: Column | str, enlarged: Column) -> Column:
    """The feature struct of binary pixels in RGB order; if ``enlarged``, of the image scaled up as a plan would."""
    found = _profiled(data, width, height, channels, enlarged)
    # Missing values take NaN's place on the way from Python.
    return found.withField("sharpness", F.when(found["brightness"].isNotNull(), F.coalesce(found["sharpness"], F.lit(NAN))))


def sharpened(pixels: np.ndarray, factor: float) -> np.ndarray:
    """Away from a 3x3 blur whose middle counts five of 13; halves to the even."""
    x = np.pad(pixels, ((1, 1), (1, 1), (0, 0)), "edge").astype(np.int16)
    across = x[:, :-2] + x[:, 1:-1] + x[:, 2:]
    around = across[:-2] + across[1:-1] + across[2:]
    x = x[1:-1, 1:-1]
    if factor == SHARPEN:  # x + (x - blur) / 2 in 26ths: whole numbers, halves exact in 32 bits
        y = np.divide(35 * x - around, 26, dtype=np.float32)
    else:
        blur = (around + 4 * x) / 13
        y = blur + (x - blur) * factor
    return np.clip(np.rint(y, out=y), 0, 255, out=y).astype(np.uint8)


def luma(pixels: np.ndarray) -> int:
    """The mean gray of an HxWxC uint8 image in whole values, halves up; of all values unless there are three channels."""
    n, c = pixels.shape[0] * pixels.shape[1], pixels.shape[2]
    sums = channel_sums(pixels)
    top, by = (sum(k * s for k, s in zip((299, 587, 114), sums, strict=True)), 1000 * n) if c == 3 else (sum(sums), c * n)
    return (2 * top + by) // (2 * by)


def apply_plan(pixels: np.ndarray, plan: list[tuple[str, float]]) -> np.ndarray:
    """A plan applied to an HxWxC uint8 image: Lanczos scaling, a 3x3 blur for sharpening; whole values after each step."""
    x, every = pixels, np.arange(256.0)
    for op, factor in plan:
        if op == "upscale":
            x = resized(x, int(x.shape[1] * factor), int(x.shape[0] * factor))
        elif op == "sharpness":
            x = sharpened(x, factor)
        else:
            if op == "invert":
                to = 255 - every
            elif op == "brightness":
                to = every * factor
            else:
                middle = luma(x)
                to = middle + (every - middle) * factor
            table = np.clip(np.round(to), 0, 255).astype(np.uint8)
            x = np.frombuffer(x.tobytes().translate(table.tobytes()), np.uint8).reshape(x.shape)
    return x


def page_mode_of(width: int, height: int) -> int:
    """``page_mode`` of one image."""
    if width / height > 4 and height < 100:
        return 7
    return 11 if width < 300 or height < 100 else 6


def enlarged(pixels: np.ndarray) -> np.ndarray:
    """A small image scaled up; others as they are."""
    h, w = pixels.shape[:2]
    factor = scale_of(w, h)
    return resized(pixels, int(w * factor), int(h * factor)) if factor > 1 else pixels


def plan_of(pixels: np.ndarray, large: np.ndarray | None = None) -> list[tuple[str, float]]:
    """``enhance_plan`` of one image, by the features it has once it is scaled up (``large``, if that is at hand)."""
    factor = scale_of(pixels.shape[1], pixels.shape[0])
    bright, contrast = tone(enlarged(pixels) if large is None else large)
    bright *= 255
    steps = [("upscale", factor, factor > 1), ("invert", 1.0, bright < 100), ("contrast", 1.8, contrast * 128 < 40), ("sharpness", SHARPEN, True), ("brightness", 1.4, bright < 80), ("brightness", 0.8, bright > 200)]
    return [(op, x) for op, x, needed in steps if needed]


def enhance(pixels: np.ndarray) -> np.ndarray:
    """An image made ready for recognition."""
    large = enlarged(pixels)
    return apply_plan(large, [step for step in plan_of(pixels, large) if step[0] != "upscale"])


_IMAGE = StructType([StructField("width", IntegerType()), StructField("height", IntegerType()), StructField("data", BinaryType())])


def _frames(images: Iterator[np.ndarray | None]) -> Iterator[pd.DataFrame]:
    """Images as rows of bounded frames; Arrow can't hold 2 GB of bytes in one, and a worker shouldn't."""
    out, held = [], 0
    for image in images:
        out.append((None, None, None) if image is None else (image.shape[1], image.shape[0], image.tobytes()))
        held += 0 if image is None else image.nbytes
        if held >= MOST_BYTES or len(out) >= 4096:
            yield pd.DataFrame(out, columns=_IMAGE.names)
            out, held = [], 0
    if out:
        yield pd.DataFrame(out, columns=_IMAGE.names)


@F.pandas_udf(_IMAGE)
def enhanced(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
    """Enhanced pixels from (data, width, height, channels, plan); pixel kernels need numpy."""
    rows = (row for batch in batches for row in zip(*batch, strict=True))
    yield from _frames(None if d is None or steps is None else apply_plan(np.frombuffer(d, np.uint8).reshape(h, w, c), [(s["op"], s["factor"]) for s in steps]) for d, w, h, c, steps in rows)


@F.pandas_udf(_IMAGE)
def made_ready(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
    """``enhanced`` by an image's own plan from (data, width, height, channels): it is scaled up once for plan and pixels."""
    rows = (row for batch in batches for row in zip(*batch, strict=True))
    yield from _frames(None if d is None or w < 1 or h < 1 or c not in (1, 3, 4) else enhance(np.frombuffer(d, np.uint8).reshape(h, w, c)) for d, w, h, c in rows)
