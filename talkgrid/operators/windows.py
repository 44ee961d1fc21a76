"""Windows over recordings: sliding, with margins, and where each starts depends on what the one before heard."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkgrid.operators.folds import ordered_fold


def sliding(recordings: DataFrame, length: float = 10.0, shift: float = 0.1, least: float = 0.25) -> DataFrame:
    """Windows (window_ix, start_s, available_s) of a length over recordings (recording_id, duration_s), each a share of the length after the
    one before; the first that has less than a share left, and all after it, are left out."""
    step = length * shift
    count = F.ceil(F.col("duration_s") / step).cast("int")
    rows = recordings.where("duration_s > 0").select("recording_id", "duration_s", F.explode(F.sequence(F.lit(0), count - 1)).alias("window_ix"))
    start = F.col("window_ix") * step
    rows = rows.select("recording_id", "window_ix", start.alias("start_s"), F.least(F.lit(length), F.col("duration_s") - start).alias("available_s"))
    return rows.where(F.col("available_s") >= length * least)


def with_margins(rows: DataFrame, at: str, core: float = 30.0, margin: float = 2.0) -> DataFrame:
    """rows once for every window (window_ix) that reads them: a core of their own, and margins before and after it; inside tells whether a row is in
    the core. What is computed by window is kept for its core's rows only, so each row has one result."""
    x = F.col(at)
    first, last = F.greatest(F.lit(0), F.floor((x - margin) / core)), F.floor((x + margin) / core)
    out = rows.withColumn("window_ix", F.explode(F.sequence(first, F.greatest(first, last))))
    near = (x >= F.col("window_ix") * core - margin) & (x < (F.col("window_ix") + 1) * core + margin)
    return out.where(near).withColumn("inside", F.floor(x / core) == F.col("window_ix"))


def adaptive(recordings: DataFrame, heard: DataFrame, length: float = 30.0, overlap: float = 2.0, least: float = 1.0) -> DataFrame:
    """Windows (recording_id, window_ix, start_s, content_s): each starts a little before the last thing heard (recording_id, seq, start_s,
    end_s) in the one before, or a fixed stride after it where that got nowhere; a window of under a second hears nothing."""
    rows = recordings.select("recording_id", "duration_s").join(heard.select("recording_id", "seq", "start_s", "end_s"), "recording_id", "left")

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        duration, start, end = part["duration_s"].iloc[0], part["start_s"].to_numpy(float), part["end_s"].to_numpy(float)
        out, at = [], 0.0
        while at < duration:
            content = min(length, duration - at)
            out.append((part["recording_id"].iloc[0], len(out), at, content))
            if at + content >= duration:
                break
            said = end[(start >= at) & (start < at + content)] if content >= 1.0 else end[:0]
            resume = min(said[-1] - overlap, at + content) if len(said) and said[-1] > 0 else at
            at = resume if resume > at + least else at + length - overlap
        return pd.DataFrame(out, columns=["recording_id", "window_ix", "start_s", "content_s"])

    return ordered_fold(rows, ["seq"], fold, "recording_id bigint, window_ix int, start_s double, content_s double")


def sprint(tokens: F.Column, limit: F.Column, slowest: float = 25.0, factor: float = 2.5) -> F.Column:
    """The most tokens a second that are believed of a recording."""
    return F.greatest(F.lit(slowest), tokens / F.greatest(F.lit(1.0), limit) * factor)


def credible_anchors(anchors: DataFrame) -> DataFrame:
    """Anchors (recording_id, second, token, tokens, limit_s: how many tokens and seconds the recording has) whose claims the clock allows:
    neither what is said before nor what is left to say would have to go too fast."""
    most = sprint(F.col("tokens"), F.col("limit_s"))
    return anchors.where((F.col("tokens") - F.col("token") <= F.greatest(F.lit(0.0), F.col("limit_s") - F.col("second")) * most) & (F.col("token") <= F.col("second") * most))


def anchor_scale(stamped_end: F.Column, limit: F.Column, smallest: float = 0.5) -> F.Column:
    """The factor that brings the stamps' end down to the recording's."""
    return F.when((stamped_end <= limit) | (limit <= 0), 1.0).otherwise(F.greatest(F.lit(smallest), F.try_divide(limit, stamped_end)))
