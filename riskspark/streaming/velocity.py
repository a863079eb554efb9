"""Card velocity on streams (F17, W8): trailing counts and amounts with state and event-time timers.

Transactions may arrive in any order within the watermark's delay.  A row's trailing hour is complete once the
watermark has passed its time, so rows wait in state until an event-time timer says so, and each is written
once with its final figures: append semantics, equal to the batch ``features.velocity``.

Cards are dealt by hash over ``GROUPS`` groups with one state and one timer each, so that a micro-batch costs a call per
group and not per card; within a group all cards are worked on at once.  A state is the group's rows as one Arrow
table: those that wait and those that a waiting or later row can look back to.  So state holds the rows of one
span and the delay, however long the stream.  Any state store provider will do.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# the step travels to the workers as it is, so that they need not have this package on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Groups of cards; fixed in a stream's checkpoint.
GROUPS = 512
_HELD = pa.schema([("card", pa.string()), ("at_second", pa.int64()), ("cents_paid", pa.int64()), ("row_json", pa.string()), ("written", pa.bool_())])


def trailing(time: np.ndarray, cents: np.ndarray, known: np.ndarray, seconds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, cents, rows with an amount) in [t - seconds, t] for each t of a sorted array."""
    lo, hi = np.searchsorted(time, time - seconds, side="left"), np.searchsorted(time, time, side="right")
    total, held = np.concatenate([[0], np.cumsum(cents)]), np.concatenate([[0], np.cumsum(known)])
    return hi - lo, total[hi] - total[lo], held[hi] - held[lo]


def trailing_by_card(card: pa.ChunkedArray, time: np.ndarray, cents: pa.ChunkedArray, seconds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``trailing`` among the rows of the same card, for rows in any order; nulls are a card, and amounts may be null."""
    code, _ = pd.factorize(card.to_pandas(), use_na_sentinel=False)
    place = code.astype(np.int64) * (int(time.max() - time.min()) + 2 * seconds + 2) + (time - time.min())  # cards lie over a span apart
    order = np.argsort(place, kind="stable")
    known = cents.is_valid().to_numpy()
    found = trailing(place[order], cents.fill_null(0).to_numpy()[order], known[order].astype(np.int64), seconds)
    back = np.argsort(order)
    return tuple(x[back] for x in found)


def velocity_step(seconds: int) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """Rows (card, second, cents, row as JSON) of a group -> (row, n, cents) once their time is final.  A null amount is a row
    without cents."""
    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tables = [pa.ipc.open_stream(bytes(state.get[0])).read_all()] if state.exists else []
        for part in parts:
            if len(part):
                tables.append(pa.Table.from_pandas(part[["card", "at_second", "cents_paid", "row_json"]].assign(written=False), _HELD, preserve_index=False))
        if not tables:
            return
        held = pa.concat_tables(tables)
        now = state.getCurrentWatermarkMs()
        due = now // 1000  # rows up to this second are complete
        time = held["at_second"].to_numpy()
        written = held["written"].to_numpy()
        ready = np.flatnonzero((time <= due) & ~written)
        if len(ready):
            n, total, with_amount = trailing_by_card(held["card"], time, held["cents_paid"], seconds)
            cents = pd.array(total[ready], "Int64")
            cents[with_amount[ready] == 0] = pd.NA
            yield pd.DataFrame({"row_json": held["row_json"].take(pa.array(ready)).to_pylist(), "n_rows": n[ready], "total_cents": cents})
        waiting = time[time > due]
        low = min(int(waiting.min()) if len(waiting) else due + 1, due + 1) - seconds  # nobody looks further back
        keep = time >= low
        if not keep.any():
            state.remove()
            return
        left = held.set_column(4, "written", pa.array(written | (time <= due))).filter(pa.array(keep))
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, _HELD) as w:
            w.write_table(left.combine_chunks())
        state.update((out.getvalue().to_pybytes(),))
        # the earliest row that waits, or the end of what can be looked back to
        wake = int(waiting.min()) if len(waiting) else int(time.max()) + seconds
        state.setTimeoutTimestamp(max(wake * 1000 - 1, now + 1))

    return run


def velocity_stream(df: DataFrame, key: str = "cc_num", time: str = "unix_time", seconds: int = 3600, amount: str = "amt",
                    delay: str = "1 hour") -> DataFrame:
    """F17 on a stream: the rows with ``txn_count_<seconds>s`` and ``amount_<seconds>s``, as in the batch.

    ``time`` is in whole epoch seconds, ``amount`` has two decimals.  Rows later than ``delay`` behind the newest are
    dropped, as are rows without a time (they have no trailing hour); a null key is a key."""
    d = df.where(F.col(time).isNotNull())
    cents = (F.col(amount).cast("decimal(18,2)") * 100).cast("bigint")
    packed = d.select(F.timestamp_seconds(time).alias("event_at"), F.pmod(F.xxhash64(key), F.lit(GROUPS)).alias("card_group"),
                      F.col(key).cast("string").alias("card"), F.col(time).cast("bigint").alias("at_second"),
                      cents.alias("cents_paid"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("row_json"))
    out = packed.withWatermark("event_at", delay).groupBy("card_group").applyInPandasWithState(
        velocity_step(seconds), "row_json string, n_rows bigint, total_cents bigint", "held binary", "append",
        GroupStateTimeout.EventTimeTimeout)
    rows = out.select(F.from_json("row_json", df.schema).alias("r"), "n_rows", "total_cents")
    return rows.select("r.*", F.col("n_rows").alias(f"txn_count_{seconds}s"),
                       (F.col("total_cents").cast("decimal(20,0)") / 100).cast("decimal(18,2)").cast("double").alias(f"amount_{seconds}s"))
