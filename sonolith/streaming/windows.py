"""Count windows over a stream of sample chunks: what a push pipeline of buffers does, with the buffers as state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FRAMES = "song string, start long, samples array<double>"
STATE = "at long, taken long, rest array<double>"


def frames(chunks: DataFrame, size: int, hop: int, limit: int | None = None) -> DataFrame:
    """chunks(song string, chunk_no long, samples array<double>) -> (song, start, samples): every whole window of `size`
    samples, one each `hop`, however the samples were cut into chunks.

    State of a song: the samples that later windows need (under `size`), and where they start. After `limit` samples a song
    has enough and the rest is dropped without being kept. Chunks of a song must arrive in the order of chunk_no across
    batches; within a batch they are sorted.
    """

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, taken, rest = state.get if state.exists else (0, 0, [])
        new = pd.concat(list(pdfs)).sort_values("chunk_no")["samples"]
        fresh = np.concatenate([np.asarray(x, float) for x in new])
        if limit is not None:
            fresh = fresh[: max(0, limit - taken)]
        whole = np.concatenate((np.asarray(rest, float), fresh))
        n = max(0, (len(whole) - size) // hop + 1)
        yield pd.DataFrame({"song": [key[0]] * n, "start": [at + k * hop for k in range(n)], "samples": [whole[k * hop : k * hop + size].tolist() for k in range(n)]})
        state.update((at + n * hop, int(taken + len(fresh)), whole[n * hop :].tolist()))

    return chunks.groupBy("song").applyInPandasWithState(run, FRAMES, STATE, "append", GroupStateTimeout.NoTimeout)
