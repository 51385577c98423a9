"""Images as arrays of pixels: structural similarity."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.measures import psnr

#: The side of the window and the two stabilising constants.
WINDOW, K1, K2 = 7, 0.01, 0.03


def masked_error(predicted: DataFrame, truth: DataFrame, masks: DataFrame, *, least: int = 4) -> DataFrame:
    """``image, n_pixels, mse, psnr`` of two sets of images over masks: long rows ``image, y, x, channel, value`` of one size.

    A pixel counts where its image's mask is above zero in some channel, or everywhere if the image has no mask; images
    of fewer than ``least`` such pixels are left out, and pixels that either side lacks.
    """
    at = ["image", "y", "x"]
    held = masks.groupBy(*at).agg((F.max("value") > 0).alias("_in"))
    masked = masks.select("image").distinct().withColumn("_masked", F.lit(True))
    both = predicted.select(*at, "channel", F.col("value").alias("_p")).join(truth.select(*at, "channel", F.col("value").alias("_t")), [*at, "channel"])
    both = both.join(masked, "image", "left").join(held, at, "left").where(F.col("_masked").isNull() | F.col("_in"))
    error = F.col("_p") - F.col("_t")
    pixels = both.groupBy(*at).agg(F.sum(error * error).alias("_e"), F.count("*").alias("_n"))
    out = pixels.groupBy("image").agg(F.count("*").alias("n_pixels"), (F.sum("_e") / F.sum("_n")).alias("mse")).where(F.col("n_pixels") >= least)
    return out.withColumn("psnr", psnr(F.col("mse")))


def window_means(image: np.ndarray, window: int) -> np.ndarray:
    """Means of the windows around every pixel; the image is mirrored at its edges, edge pixels included."""
    held = np.pad(image, window // 2, mode="symmetric")
    return sliding_window_view(held, (window, window)).mean((2, 3))


def ssim_map(a: np.ndarray, b: np.ndarray, data_range: float, window: int = WINDOW) -> np.ndarray:
    """Similarity of two images around every pixel, with sample covariances."""
    n = window * window
    ma, mb = window_means(a, window), window_means(b, window)
    unbiased = n / (n - 1)
    va, vb = unbiased * (window_means(a * a, window) - ma * ma), unbiased * (window_means(b * b, window) - mb * mb)
    both = unbiased * (window_means(a * b, window) - ma * mb)
    c1, c2 = (K1 * data_range) ** 2, (K2 * data_range) ** 2
    return (2 * ma * mb + c1) * (2 * both + c2) / ((ma * ma + mb * mb + c1) * (va + vb + c2))


def masked_ssim(pairs: DataFrame, key: str, a: str, b: str, mask: str, side: int, data_range: float = 1.0) -> DataFrame:
    """``key, ssim, n_pixels``: the mean of a pair's similarity map over its mask.

    ``a`` and ``b`` are row-major arrays of ``side * side`` doubles, ``mask`` one of booleans. A null or
    misshapen array, or an empty mask, gives a null ``ssim``. Each pair is a row of an Arrow batch; nothing is shuffled.
    """

    def run(batches):
        for batch in batches:
            values, sizes = [], []
            for p, q, m in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                whole = all(x is not None and len(x) == side * side for x in (p, q, m))
                held = np.array([bool(x) for x in m]).reshape(side, side) if whole else np.zeros((1, 1), bool)
                sizes.append(int(held.sum()))
                if not held.any() or None in p or None in q:
                    values.append(None)
                    continue
                shape = lambda x: np.array(x, float).reshape(side, side)
                values.append(float(ssim_map(shape(p), shape(q), data_range)[held].mean()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64()), pa.array(sizes, pa.int64())], [key, "ssim", "n_pixels"])

    kind = pairs.schema[key].dataType.simpleString()
    return pairs.select(key, a, b, mask).mapInArrow(run, f"{key} {kind}, ssim double, n_pixels long")
