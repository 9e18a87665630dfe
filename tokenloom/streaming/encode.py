"""Streams: the encode plan is row-local, so it is the batch plan on a streaming DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.tokenizer import Tokenizer


def token_windows(stream: DataFrame, tok: Tokenizer, text: str, time: str, width: str = "1 hour", slide: str | None = None, gap: str | None = None, late: str = "10 minutes", by: tuple[str, ...] = ()) -> DataFrame:
    """Tokens for each event-time window and value of ``by``: tumbling windows, sliding ones with ``slide``, or sessions that end after
    ``gap`` without a row (on a stream these need a column to go by).

    Rows later than ``late`` are dropped with the state of their window.
    """
    counted = tok.encode(stream.withWatermark(time, late), text, "tokens", False)
    of = F.session_window(time, gap) if gap else F.window(time, width, slide)
    grouped = counted.groupBy(*by, of.alias("w")).agg(F.sum(F.size("tokens")).cast("long").alias("n_tokens"), F.count("*").alias("n_rows"))
    return grouped.select(*by, F.col("w.start").alias("start"), "n_tokens", "n_rows")
