"""Live variable snapshots: messages by type and changed values on a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexloom.operators import write_back
from lexloom.sources import save_files


def messages(lines: DataFrame, kind: str, schema: str, column: str = "value") -> DataFrame:
    """Messages of one type from lines of JSON; malformed lines are dropped."""
    head = F.get_json_object(column, "$.type")
    return lines.where(head == kind).select(F.from_json(column, schema).alias("m")).where("m IS NOT NULL").select("m.*")


#: What a value scan looks for: of the last value (null: none) and the present one.
_SCANS = {
    "equal": lambda last, now, wanted: now is not None and now == wanted,
    "changed": lambda last, now, wanted: None not in (last, now) and now != last,
    "unchanged": lambda last, now, wanted: None not in (last, now) and now == last,
    "increased": lambda last, now, wanted: None not in (last, now) and now > last,
    "decreased": lambda last, now, wanted: None not in (last, now) and now < last,
    "new": lambda last, now, wanted: now is not None and now != last,
}


def _held(value: object) -> object:
    return None if pd.isna(value) else value


def stream_scan(rows: DataFrame, keys: list[str], order: list[str], value: str, mode: str, wanted: object = None) -> DataFrame:
    """keys, previous, current of every value that does what mode says (a key of _SCANS; equal: is the wanted one) since the one before it; a key's last value is all its state.

    Rows of a key are ordered within a micro-batch; a row that comes late meets what is newest by then. After a null there is
    no last value, but for `new`, which looks past nulls.
    """
    kinds, rule = dict(rows.dtypes), _SCANS[mode]
    out = ", ".join(f"{k} {kinds[k]}" for k in keys) + f", previous {kinds[value]}, current {kinds[value]}"
    past = mode == "new"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = _held(state.get[0]) if state.exists else None
        found = []
        for r in map(_held, pd.concat(list(batches)).sort_values(order)[value]):
            if rule(last, r, wanted):
                found.append((*key, last, r))
            last = last if past and r is None else r
        state.update((last,))
        yield pd.DataFrame(found, columns=[*keys, "previous", "current"])

    return rows.groupBy(*keys).applyInPandasWithState(step, out, f"last {kinds[value]}", "append", GroupStateTimeout.NoTimeout)


def stream_changes(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """keys, previous, current for every change. A null neither changes nor is changed from."""
    return stream_scan(rows, keys, order, value, "changed")


def until_changed(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """keys, value: each value that differs from the key's last one, the first included: what has to be passed on."""
    return stream_scan(rows, keys, order, value, "new").select(*keys, F.col("current").alias(value))


def once_for_each(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key (an attachment of a game, say) and no later one: when its answer has to be sent once. Only a flag is kept of a key."""
    kinds, names = dict(rows.dtypes), rows.columns
    out = ", ".join(f"`{c}` {kinds[c]}" for c in names)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if not state.exists:
            state.update((True,))
            yield pd.concat(list(batches)).sort_values(order).head(1)[names]

    return rows.groupBy(*keys).applyInPandasWithState(step, out, "sent boolean", "append", GroupStateTimeout.NoTimeout)


def write_slots(slots: DataFrame, game: str, synced: str, folder: str, checkpoint: str) -> DataStreamWriter:
    """A writer that publishes the slots (id, date, data, ord) of each micro-batch. A slot's file is named by what it is, so a batch that runs again writes the same files."""

    def publish(batch: DataFrame, _: int) -> None:
        write_back.publish(save_files.slot_files(batch, game, synced), folder)

    return slots.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint)
