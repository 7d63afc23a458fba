"""Quality metrics: frames and audio against references, channel correlation, best lag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def frame_error(a: Column | str, b: Column | str) -> dict[str, Column]:
    """max_error, mse and psnr (of 255) of two pixel arrays of equal length; equal frames have an infinite psnr."""
    diff = F.zip_with(a, b, lambda x, y: x - y)
    top = F.array_max(F.transform(diff, lambda x: F.abs(x)))
    mse = F.aggregate(diff, F.lit(0.0), lambda s, x: s + x * x) / F.size(diff)
    psnr = F.when(mse == 0, F.lit(float("inf"))).otherwise(20 * F.log10(F.lit(255.0) / F.sqrt(mse)))
    return {"max_error": top, "mse": mse, "psnr": psnr}


def audio_error(reference: Column | str, test: Column | str) -> dict[str, Column]:
    """psnr (of 1.0) and precision (reference power over itself plus the error's, in percent) of two sample arrays."""
    diff = F.zip_with(reference, test, lambda x, y: x - y)
    n = F.size(diff)
    mse = F.aggregate(diff, F.lit(0.0), lambda s, x: s + x * x) / n
    power = F.aggregate(reference, F.lit(0.0), lambda s, x: s + x * x) / n
    precision = F.when(mse == 0, F.lit(100.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), power / (power + mse) * 100)))
    return {"psnr": F.when(mse == 0, F.lit(float("inf"))).otherwise(-10 * F.log10(mse)), "precision": precision}


def channel_correlation(samples: DataFrame) -> DataFrame:
    """samples (frame_no, channel, i, v): correlation of each pair of channels a <= b of the same frame."""
    left = samples.select("frame_no", "i", F.col("channel").alias("a"), F.col("v").alias("x"))
    right = samples.select("frame_no", "i", F.col("channel").alias("b"), F.col("v").alias("y"))
    return left.join(right, ["frame_no", "i"]).where("a <= b").groupBy("a", "b").agg(F.corr("x", "y").alias("corr"))


def best_lag(reference: str, test: str, max_lag: int) -> Column:
    """The lag in -max_lag..max_lag at which sum(reference[i] * test[i + lag]) is largest; ties take the smallest lag."""
    ref, tst = F.col(reference), F.col(test)

    def score(lag):
        terms = F.transform(F.sequence(F.lit(0), F.size(ref) - 1), lambda i: F.when((i + lag >= 0) & (i + lag < F.size(tst)), F.element_at(ref, i + 1) * F.element_at(tst, (i + lag + 1).cast("int"))).otherwise(0.0))
        return F.struct(F.round(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x), 9).alias("score"), (-lag).alias("minus"))

    lags = F.transform(F.sequence(F.lit(-max_lag), F.lit(max_lag)), score)
    return -F.array_max(lags)["minus"]
