"""The latest colour of each pixel in each window as a stream with state by key, whatever order its rows arrive in.

State is, for each pixel, its open windows: the time and colour of the latest row in each. A row replaces what is there if
(ts, colour) is greater, so the order of arrival, repeats and late rows make no difference while the window is open. A
window's row goes out once the watermark has passed its end, by an event-time timer set to the earliest open window; state
then holds nothing of it, and a row that comes even later is dropped, as the watermark promises.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "t timestamp, pixel long, colour int"
STATE = "starts array<long>, stamps array<long>, colours array<int>"


def latest_colour_stream(pixels: DataFrame, late: str = "1 hour", minutes: int = 15) -> DataFrame:
    """(t, pixel, colour) of each window of so many minutes once it is over; pixels is a stream of (ts timestamp, pixel long, colour int).

    Rows with a null in any column are left out. On a table the same rows are latest_colours'. State grows with the open
    windows of the pixels seen, hence with ``late``, not with the stream.
    """
    width = minutes * 60_000_000

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {s: (at, c) for s, at, c in zip(*state.get, strict=True)} if state.exists else {}
        passed = state.getCurrentWatermarkMs() * 1000
        for df in frames:
            stamps = df["_us"].to_numpy()
            starts = stamps // width * width
            for start, at, colour in zip(starts.tolist(), stamps.tolist(), df["colour"].tolist(), strict=True):
                if start + width > passed and (at, colour) > held.get(start, (-1, -1)):
                    held[start] = (at, colour)
        over = sorted(s for s in held if s + width <= passed)
        if over:
            yield pd.DataFrame({"t": pd.to_datetime(over, unit="us"), "pixel": [key[0]] * len(over), "colour": [held.pop(s)[1] for s in over]})
        if held:
            still = sorted(held)
            state.update((still, [held[s][0] for s in still], [held[s][1] for s in still]))
            state.setTimeoutTimestamp(max((still[0] + width) // 1000, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()

    own = pixels.na.drop(subset=["ts", "pixel", "colour"]).withWatermark("ts", late)
    keyed = own.select("ts", "pixel", "colour", F.unix_micros("ts").alias("_us"))
    return keyed.groupBy("pixel").applyInPandasWithState(update, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
