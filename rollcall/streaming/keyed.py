"""Play time as keyed streaming state: a batch touches its own servers only.

Every server is cut into splits by hash of the player, so that a server with very many
rows is many keys. A key holds the snapshots of the lateness window by the hour, each
with its clients of that split and the seconds that they were credited. A snapshot that
comes late is put in its place: what it is worth is emitted, and what the snapshot
behind it is worth less now, so the sums of all deltas are the batch result, in
whatever order the rows came.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rollcall.operators import playtime
from rollcall.operators.asof import PLAY_GAP_CREDIT, PLAY_GAP_SECONDS
from rollcall.session import keyed_state, remove
from rollcall.streaming.feed import LATENESS
from rollcall.streaming.live import LiveTables

SPLITS = 8
HOUR = 3_600_000_000  # microseconds
# The snapshots of an hour in the order of time and id, as an Arrow stream: Spark hands
# over the values of a state one by one in Python, but this as one.
HELD = "polls binary"
POLLS = pa.schema([
    ("t", pa.int64()), ("id", pa.int64()), ("map", pa.string()), ("game_type", pa.string()), ("worth", pa.int64()),
    ("players", pa.list_(pa.string())), ("clans", pa.list_(pa.string()))])
OUT = "kind string, server string, map string, game_type string, player string, clan string, credit long, snapshot_id long, t long"

# The worker that prepares the state on the driver gets no files of the session
# (addPyFile, --py-files), so the operator travels whole.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def worth(before: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Seconds that snapshots are worth behind those at ``before``."""
    seconds = (t - before) // 1_000_000
    return np.where(seconds > PLAY_GAP_SECONDS, PLAY_GAP_CREDIT, np.maximum(seconds, 0))


def texts(values) -> np.ndarray:
    """Texts as objects, a missing one as None."""
    out = np.array(values, dtype=object)
    out[pd.isna(out)] = None
    return out


class Credits(StatefulProcessor):
    """State of one (server, split): a map from the hour to its snapshots. A timer lets
    hours go when the watermark has passed them, but for the last snapshot before it,
    which the next one is measured from."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.hours = handle.getMapState("hours", "hour long", HELD)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        reached = 1000 * timerValues.getCurrentWatermarkInMs()
        new = pd.concat(list(rows), ignore_index=True)
        behind = new["t"] < reached
        told = new[behind & new["own"]]
        out = [told.assign(kind="behind", server=key[0], credit=0)] if len(told) else []
        new = new[~behind].sort_values(["t", "snapshot_id", "ordinal"], kind="stable")
        if len(new):
            out.append(self._taken_in(key[0], new))
        for found in out:
            if len(found):
                yield found[[c.split(" ")[0] for c in OUT.split(", ")]]

    def _taken_in(self, server: str, new: pd.DataFrame) -> pd.DataFrame:
        known = np.array(sorted(k[0] for k in self.hours.keys()), dtype=np.int64)
        t, ids = (new[c].to_numpy(np.int64) for c in ("t", "snapshot_id"))
        touched = np.unique(t // HOUR)
        hours = np.union1d(known, touched)
        at = np.searchsorted(hours, touched)
        measured = np.union1d(touched, hours[np.minimum(at + 1, len(hours) - 1)])
        wanted = np.union1d(measured, hours[np.maximum(at - 1, 0)])  # measured from the hours before
        held = pa.concat_tables([POLLS.empty_table(), *(self._held(h) for h in np.intersect1d(wanted, known).tolist())])
        old_t, old_id, old_map, old_game, old_worth = (held[c].to_numpy() for c in POLLS.names[:5])
        crowd = pc.list_value_length(held["players"]).to_numpy()
        old_player, old_clan = (pc.list_flatten(held[c]).to_numpy() for c in ("players", "clans"))

        # Snapshots of both, one per time and id: a held one, or the first of the new rows.
        place, first = merged([old_t, t], [old_id, ids])
        poll_t, poll_id = (np.concatenate(c)[first] for c in ((old_t, t), (old_id, ids)))
        poll_map, poll_game = (np.concatenate([c, texts(new[n])])[first] for c, n in ((old_map, "map"), (old_game, "game_type")))
        before = np.concatenate([old_worth, np.zeros(len(t), np.int64)])[first]

        # Their clients, each once: held ones come first.
        names = texts(new["player"])
        named = np.flatnonzero(names != None)  # noqa: E711
        where = np.concatenate([np.repeat(place[:len(crowd)], crowd), place[len(crowd):][named]])
        player, clan = np.concatenate([old_player, names[named]]), np.concatenate([old_clan, texts(new["clan"])[named]])
        credited = np.concatenate([np.repeat(old_worth, crowd), np.zeros(len(named), np.int64)])
        _, once = np.unique(where * (len(player) + 1) + pd.factorize(player)[0], return_index=True)
        once = once[np.lexsort((once, where[once]))]
        where, player, clan, credited = (c[once] for c in (where, player, clan, credited))

        # Of several at one time none is measured from another.
        times, nth = np.unique(poll_t, return_inverse=True)
        value = np.where(nth > 0, worth(times[nth - 1], poll_t), 0)
        value = np.where(np.isin(poll_t // HOUR, measured), value, before)
        self._hold(np.union1d(touched, np.unique(poll_t[value != before] // HOUR)),
                   [poll_t, poll_id, poll_map, poll_game, value], np.bincount(where, minlength=len(poll_t)), [player, clan])
        self.handle.registerTimer((int(hours[0]) + 1) * HOUR // 1000)
        delta = value[where] - credited
        out = np.flatnonzero(delta)
        where = where[out]
        return pd.DataFrame({
            "kind": "credit", "server": server, "map": poll_map[where], "game_type": poll_game[where], "player": player[out],
            "clan": clan[out], "credit": delta[out], "snapshot_id": poll_id[where], "t": poll_t[where]})

    def _held(self, hour: int) -> pa.Table:
        return pa.ipc.open_stream(bytes(self.hours.getValue((hour,))[0])).read_all()

    def _write(self, hour: int, polls: pa.RecordBatch) -> None:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, POLLS) as stream:
            stream.write_batch(polls)
        self.hours.updateValue((hour,), (sink.getvalue().to_pybytes(),))

    def _hold(self, hours: np.ndarray, polls: list[np.ndarray], crowd: np.ndarray, clients: list[np.ndarray]) -> None:
        """Writes ``hours`` of the columns of snapshots and, behind each other, their clients."""
        ends = np.concatenate([[0], np.cumsum(crowd)])
        texts = [pa.array(c, pa.string()) for c in clients]
        first, last = (np.searchsorted(polls[0], h * HOUR) for h in (hours, hours + 1))
        for hour, a, b in zip(hours.tolist(), first.tolist(), last.tolist()):
            at = pa.array(ends[a : b + 1] - ends[a], pa.int32())
            lists = [pa.ListArray.from_arrays(at, c.slice(ends[a], ends[b] - ends[a])) for c in texts]
            self._write(hour, pa.record_batch([*(pa.array(c[a:b], f.type) for c, f in zip(polls, POLLS)), *lists], schema=POLLS))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        reached = 1000 * timerValues.getCurrentWatermarkInMs()
        known = sorted(k[0] for k in self.hours.keys())
        passed = [h for h in known if (h + 1) * HOUR <= reached]
        for hour in passed[:-1]:
            self.hours.removeKey((hour,))
        if passed:  # later rows are measured from the last one, nothing is put before it
            last = self._held(passed[-1])
            last = last.slice(last.num_rows - 1).to_pylist()[0]
            self._write(passed[-1], pa.RecordBatch.from_pylist([last | {"players": [], "clans": []}], POLLS))
        if len(known) > len(passed):
            self.handle.registerTimer((known[len(passed)] + 1) * HOUR // 1000)
        return iter([])

    def close(self) -> None:
        pass


def merged(t: list[np.ndarray], ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Several columns of (time, id) as one ordered list of distinct ones: the place of
    each in that list, and where each of the list is met first."""
    all_t, all_ids = np.concatenate(t), np.concatenate(ids)
    order = np.lexsort((all_ids, all_t))  # stable
    starts = np.ones(len(order), bool)
    starts[1:] = (np.diff(all_t[order]) != 0) | (np.diff(all_ids[order]) != 0)
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(starts) - 1
    return place, order[starts]


def split_rows(feed: DataFrame, splits: int = SPLITS) -> DataFrame:
    """Flat rows dealt to (server, split): a client to the split of its player, the
    snapshot itself (of its first row, ordinal 0 or none) to all splits. ``own`` marks
    one copy of every row."""
    home = F.coalesce(F.pmod(F.xxhash64("player"), F.lit(splits)), F.lit(0)).cast("int")
    first = F.coalesce(F.col("ordinal") == 0, F.lit(True))
    everywhere = F.sequence(F.lit(0), F.lit(splits - 1))
    return (
        feed.withColumn("_home", home)
        .withColumn("split", F.explode(F.when(first, everywhere).otherwise(F.array("_home"))))
        .withColumn("own", F.col("split") == F.col("_home"))
        .select(
            F.col("server").cast("string").alias("server"), "split", F.unix_micros("ts").alias("t"), "snapshot_id",
            F.col("map").cast("string").alias("map"), "game_type", F.coalesce("ordinal", F.lit(0)).cast("long").alias("ordinal"),
            F.when(F.col("own"), F.col("player")).alias("player"), F.when(F.col("own"), F.col("clan")).alias("clan"), "own",
        )
    )


def credit_stream(feed: DataFrame, lateness: str = LATENESS, splits: int = SPLITS) -> DataFrame:
    """Deltas of play time (``kind`` credit) of a stream of flat rows, and the rows that
    came behind the watermark (``kind`` behind), each row of the feed once. Rows that are
    delivered again change nothing. The time column stops at the watermark, so Spark
    itself drops no row: the operator sees all of them and tells."""
    rows = split_rows(feed.withWatermark("ts", lateness), splits)
    return rows.groupBy("server", "split").transformWithStateInPandas(Credits(), OUT, "Append", "EventTime")


class KeyedTables(LiveTables):
    """Play time from :func:`credit_stream`. ``playtime`` has the deltas of each batch
    as in :class:`LiveTables`; ``behind`` the rows behind the watermark, by batch."""

    def take(self, out: DataFrame, batch: int) -> None:
        """``foreachBatch`` body. A batch that runs again replaces what it wrote."""
        out = out.persist()
        try:
            credits = out.where("kind = 'credit'")
            self._write(playtime.all_totals(credits), "playtime", batch)
            behind = out.where("kind = 'behind'").drop("kind", "credit")
            remove(self.spark, f"{self.root}/behind/batch={batch}")
            if not behind.isEmpty():
                self._write(behind.withColumn("ts", F.timestamp_micros("t")).drop("t"), "behind", batch)
        finally:
            out.unpersist()
        if batch % self.compact_every == self.compact_every - 1:
            self._fold("playtime", batch)

    def _fold(self, table: str, batch: int) -> None:
        older = [b for b in self._batches(f"{table}_base") if b < batch]
        self._write(self._combined(table, batch), f"{table}_base", batch)
        if older:
            self._drop(table, older[-1])
            self._drop(f"{table}_base", older[-1] - 1)

    def has_batches(self) -> bool:
        return bool(self._batches("playtime"))

    def behind(self) -> DataFrame:
        """All rows so far that came behind the watermark, with their batch."""
        return self._read("behind", "server string, map string, game_type string, player string, clan string, snapshot_id long, ts timestamp")

    def rows_behind(self) -> DataFrame:
        """How many of them each batch had."""
        return self.behind().groupBy("batch").agg(F.count(F.lit(1)).alias("rows"))

    def days_to_rebuild(self) -> DataFrame:
        """Days that hold rows behind the watermark: their tables want a rebuild from the archive."""
        return self.behind().select(F.to_date("ts").alias("day")).distinct()


def start_keyed(feed: DataFrame, tables: KeyedTables, checkpoint: str, lateness: str = LATENESS,
                splits: int = SPLITS, trigger: dict | None = None):
    """Run ``feed`` (flat rows) into the tables. Number of splits and lateness belong to
    the checkpoint: they must stay as they are."""
    tables.check_checkpoint(checkpoint)
    writer = (
        credit_stream(feed, lateness, splits).writeStream.foreachBatch(tables.take)
        .option("checkpointLocation", checkpoint).outputMode("append")
        .trigger(**(trigger or {"availableNow": True}))
    )
    with keyed_state(tables.spark):
        return writer.start()
