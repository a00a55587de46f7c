"""Best row per key on a stream: newest snapshot, best pick, first standing, latest round.

The state of a key is the order values of its best row, not the row itself, so page bodies are
never kept. A row comes out whenever it takes a key's first place; the last one out of a key is
what ``first_per_key`` gives for all rows seen, as long as the key has not expired.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kickpool.operators.upsert import upsert_table

TIME = "_event_time"


def plain(value):
    """A value of a state: no value for any of pandas' missing ones."""
    if value is None or value is pd.NaT or value != value:
        return None
    return value.item() if hasattr(value, "item") else value


def best_rows(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[tuple[str, str]],
    event_time: str,
    late: str = "1 day",
    keep_seconds: int = 7 * 86_400,
) -> DataFrame:
    """Rows that take their key's first place, in ``order`` of columns each ``asc`` or ``desc``.

    A missing value is last either way; of rows equal in all of ``order`` the first seen stays, so
    a file that is read again changes nothing. Rows more than ``late`` behind the newest event time
    are dropped. A key is forgotten when ``keep_seconds`` of event time have passed since its last
    row; a later row starts it anew. Rows of a key come in portions, so a key that has most of a
    batch needs no more memory than another; rows without event time or key take part as NULL keys
    do in a grouping.
    """
    downs = [direction == "desc" for _, direction in order]
    columns = [name for name, _ in order]
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    for name in columns:  # a state holds whole numbers, reals, texts, times
        if isinstance(kinds[name], (T.StructType, T.ArrayType, T.MapType)):
            raise ValueError(f"cannot order by {name}")
    state_type = T.StructType([T.StructField(f"s{i}", kinds[name]) for i, name in enumerate(columns)])

    def better(new: tuple, old: tuple) -> bool:
        for a, b, down in zip(new, old, downs):
            if a == b:
                continue
            if a is None or b is None:
                return b is None
            return (a > b) == down
        return False

    def update(key: tuple, portions: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        best = tuple(plain(v) for v in state.get) if state.exists else None
        winner, newest = None, None
        for portion in portions:
            latest = portion[TIME].max()
            newest = latest if newest is None else max(newest, latest)
            values = [[plain(v) for v in portion[name]] for name in columns]
            for at, one in enumerate(zip(*values)):
                if best is None or better(one, best):
                    best, winner = one, portion.iloc[at : at + 1].drop(columns=TIME)
        if best is not None:
            state.update(best)
            state.setTimeoutTimestamp(max(int(newest * 1000), state.getCurrentWatermarkMs()) + keep_seconds * 1000)
        if winner is not None:
            yield winner

    timed = rows.withWatermark(event_time, late).withColumn(TIME, F.col(event_time).cast("double"))
    grouped = timed.groupBy(*keys)
    return grouped.applyInPandasWithState(
        update, rows.schema, state_type, "update", GroupStateTimeout.EventTimeTimeout
    )


def keep_best(
    rows: DataFrame, path: str, checkpoint: str, keys: Sequence[str], order: Sequence[tuple[str, str]], event_time: str, **limits
):
    """Start a stream that keeps the best row of each key in a table at ``path``.

    A micro-batch holds one row a key at most, so it is upserted as it is; a batch that is run
    again after a failure finds the state of before and upserts the same rows.
    """

    def apply(batch: DataFrame, _: int) -> None:
        upsert_table(path, batch, keys)

    found = best_rows(rows, keys, order, event_time, **limits)
    writer = found.writeStream.foreachBatch(apply).outputMode("update").option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
