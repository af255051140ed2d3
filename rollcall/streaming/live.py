"""One stream of snapshots fanned out to play time and ratings.

Every micro-batch runs the batch operators. What they need from earlier batches
is kept as tables under ``root``, each batch writing its own directory, so a
batch that is run again replaces what it wrote:

  state/batch=N     last snapshot of every server, with its client list
  late/batch=N      rows too late for the live path, until ``reconcile`` has them
  corrections/batch=N  play-time deltas of late rows up to that batch
  playtime/batch=N  play-time deltas
  ratings/          Elo ratings per map and per game type, a period per batch
  times/batch=N     best times seen
  info/batch=N      clients of ranked snapshots, spectators and joiners too

Play time, times and info also have a ``_base`` table that holds everything up to a batch,
written now and then so that reading stays cheap.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.jobs import clients_of, headers_of
from rollcall.operators import playtime, rating
from rollcall.operators.prepare import first_occurrence
from rollcall.schema import RANK_METHODS
from rollcall.session import folder_values, has_files, remove
from rollcall.sources.rating_store import RatingStore

STATE = ("server string, ts timestamp, snapshot_id long, map string, "
         "clients array<struct<ordinal:int,player:string,score:int,in_game:boolean>>")
# Delta tables: columns, key columns, value column and how values of a key combine.
DELTAS = {
    "playtime": (
        "total string, server string, map string, game_type string, clan string, player string, "
        "play_time long",
        ["total", "server", "map", "game_type", "clan", "player"], "play_time", F.sum),
    "times": ("map string, player string, rating double", ["map", "player"], "rating", F.max),
    "info": ("rank_method string, scope string, place string, player string, seen int",
             ["rank_method", "scope", "place", "player"], "seen", F.max),
}
SCOPES = ("map", "game_type")


@dataclass(frozen=True)
class LiveTables:
    """Play time and ratings kept up by a stream."""

    spark: SparkSession
    root: str
    max_gap_minutes: int = rating.MAX_GAP_MINUTES
    compact_every: int = 50

    # reading

    def _batches(self, table: str) -> list[int]:
        return sorted(int(v) for v in folder_values(self.spark, f"{self.root}/{table}", "batch"))

    def has_batches(self) -> bool:
        return bool(self._batches("state"))

    def check_checkpoint(self, checkpoint: str) -> None:
        """Batches are numbered by the checkpoint. With a new one they would start over
        and replace the tables' first batches, so tables that hold any refuse it."""
        if self.has_batches() and not has_files(self.spark, f"{checkpoint}/offsets"):
            raise ValueError(f"{self.root} holds batches of another checkpoint than {checkpoint}")

    def _read(self, table: str, schema: str) -> DataFrame:
        schema = f"{schema}, batch long"
        if not self._batches(table):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{table}")

    def _combined(self, table: str, batch: int | None = None) -> DataFrame:
        """Newest base and the deltas after it. For a running ``batch`` only
        older bases count, so that a batch run again never reads a base it is
        to replace."""
        schema, keys, value, combine = DELTAS[table]
        bases = [b for b in self._batches(f"{table}_base") if batch is None or b < batch]
        newest = bases[-1] if bases else -1
        deltas = self._read(table, schema).where(F.col("batch") > newest)
        if batch is not None:
            deltas = deltas.where(F.col("batch") <= batch)
        rows = deltas.drop("batch")
        if table == "playtime" and batch is None:
            rows = rows.unionByName(self._read("corrections", schema).drop("batch"))
        if bases:
            base = self._read(f"{table}_base", schema).where(F.col("batch") == newest)
            rows = rows.unionByName(base.drop("batch"))
        return rows.groupBy(*keys).agg(combine(value).alias(value))

    def play_time(self) -> DataFrame:
        """Totals so far."""
        return self._combined("playtime")

    @property
    def store(self) -> RatingStore:
        keys = T.StructType.fromDDL("scope string, place string, player string")
        return RatingStore(self.spark, f"{self.root}/ratings", keys, self.compact_every)

    def ratings(self) -> DataFrame:
        """Elo ratings so far."""
        return self.store.read()

    def best_times(self) -> DataFrame:
        return self._combined("times")

    def info_rows(self) -> DataFrame:
        """Ratings as boards list them: (rank_method, scope, place, player, rating) of
        every client of a ranked snapshot, 0 without a match, null without a time."""
        elo, time = (F.lit(m) for m in RANK_METHODS)
        rated = self.ratings().select(elo.alias("rank_method"), "scope", "place", "player", "rating").unionByName(
            self.best_times().select(time.alias("rank_method"), F.lit("map").alias("scope"), F.col("map").alias("place"), "player", "rating"))
        keys = DELTAS["info"][1]
        start = F.when(F.col("rank_method") == RANK_METHODS[0], F.lit(0.0))
        return rated.unionByName(
            self._combined("info").select(*keys).join(rated.select(*keys), keys, "left_anti").withColumn("rating", start))

    def last_states(self, before: int) -> DataFrame:
        return self._read("state", STATE).where(F.col("batch") == before - 1).drop("batch")

    # writing

    def _write(self, df: DataFrame, table: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/{table}/batch={batch}")

    def _drop(self, table: str, upto: int) -> None:
        for batch in self._batches(table):
            if batch <= upto:
                remove(self.spark, f"{self.root}/{table}/batch={batch}")

    def _compact(self, batch: int) -> None:
        """New bases. The base before and the deltas after it stay, in case
        this batch runs again; what they cover goes."""
        for table in DELTAS:
            older = [b for b in self._batches(f"{table}_base") if b < batch]
            self._write(self._combined(table, batch), f"{table}_base", batch)
            if older:
                self._drop(table, older[-1])
                self._drop(f"{table}_base", older[-1] - 1)
        self._drop("state", batch - 2)

    def process(self, rows: DataFrame, batch: int) -> None:
        """``foreachBatch`` body: flat rows with an extra ``rank_method``."""
        rows = rows.withColumns({c: F.col(c).cast("string") for c in ("server", "map")})
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            self._process(rows, batch)
        finally:
            rows.unpersist()

    def _process(self, rows: DataFrame, batch: int) -> None:
        before = self.last_states(batch)
        self._write(self._times(rows), "times", batch)  # a best time has no order
        reached = before.select("server", F.col("ts").alias("_reached"))
        marked = rows.join(reached, "server", "left")
        too_late = F.col("_reached").isNotNull() & (F.col("ts") <= F.col("_reached"))
        late = marked.where(too_late).drop("_reached")
        remove(self.spark, f"{self.root}/late/batch={batch}")
        if not late.isEmpty():
            self._write(late, "late", batch)
        live = marked.where(~too_late).drop("_reached")
        headers, clients = headers_of(live), clients_of(live)

        credits = playtime.credited(headers, clients, last_known=before)
        self._write(playtime.all_totals(credits), "playtime", batch)
        self._rank(live, headers, clients, before, batch)
        self._write(self._next_states(headers, clients, before), "state", batch)
        if batch % self.compact_every == self.compact_every - 1:
            self._compact(batch)

    def _rank(self, live: DataFrame, headers: DataFrame, clients: DataFrame, before: DataFrame,
              batch: int) -> None:
        elo = RANK_METHODS[0]
        methods = live.select("snapshot_id", "rank_method").distinct()

        def of(df: DataFrame, method: str) -> DataFrame:
            chosen = methods.where(F.col("rank_method") == method)
            return df.join(chosen, "snapshot_id", "left_semi")

        earlier = before.select("snapshot_id", F.inline("clients"))
        deltas = rating.score_deltas(
            headers, clients, self.max_gap_minutes, last_known=before, earlier_clients=earlier)
        deltas = of(deltas, elo).persist(StorageLevel.MEMORY_AND_DISK)
        matches = rating.ranked_matches(deltas)
        # Both scopes in one round: a match and a place exist once per scope.
        scoped = F.explode(F.array(*[
            F.struct(F.lit(s).alias("scope"), F.col(s).alias("place")) for s in SCOPES
        ]))
        twice = matches.withColumn("at", scoped).withColumn(
            "snapshot_id", F.struct("at.scope", "snapshot_id"))
        # Only the buckets of this batch's players are read and written.
        stored = self.store.lookup(twice.select("at.*", "player"), batch).select(
            F.struct("scope", "place").alias("at"), "player", "rating")
        moved = rating.elo_round(twice, stored, "at").groupBy("at", "player").agg(
            F.sum(F.when(F.col("elo_delta") != 0, F.col("elo_delta"))).alias("elo_delta"))
        self.store.add(moved.select("at.*", "player", F.coalesce("elo_delta", F.lit(0.0)).alias("elo_delta")), batch)

        ranked = live.join(matches.select("snapshot_id").distinct(), "snapshot_id", "left_semi")
        timed = live.where(F.col("rank_method") == RANK_METHODS[1])
        info = ranked.select(F.lit(elo).alias("rank_method"), scoped.alias("at"), "player").select("rank_method", "at.*", "player").unionByName(
            timed.select("rank_method", F.lit("map").alias("scope"), F.col("map").alias("place"), "player"))
        info = info.where("player is not null").distinct()
        self._write(info.withColumn("seen", F.lit(1)), "info", batch)
        deltas.unpersist()

    def _times(self, rows: DataFrame) -> DataFrame:
        timed = rows.where(F.col("rank_method") == RANK_METHODS[1])
        return rating.best_times(headers_of(timed), clients_of(timed))

    # late rows

    def late_batches(self) -> list[int]:
        """Batches whose late rows wait for :meth:`reconcile`."""
        return self._batches("late")

    def reconcile(self, history: DataFrame) -> int:
        """Bring the play time of servers with late rows level with the batch
        result; returns how many late batches were taken in.

        ``history`` holds the flat rows of these servers, late ones included (the
        archive and the hot rows). The headers of a server with late rows are measured
        with and without them; only snapshots whose credit differs, the late ones and
        those right behind them, meet their clients. What the live path missed is
        written under the highest batch taken in, before its late rows go, so a run that
        died half way only has to delete. Best times take late rows at once. Elo changes
        of late rows are left out: they depend on the order in which matches are rated,
        and ``rating.elo_rounds`` over the archive has them.
        """
        done = max(self._batches("corrections"), default=-1)
        self._drop("late", done)
        taken = self._batches("late")
        if not taken:
            return 0
        late = self.spark.read.parquet(f"{self.root}/late").where(F.col("batch") <= taken[-1])
        history = history.withColumns({c: F.col(c).cast("string") for c in ("server", "map")})
        whole = history.join(late.select("server").distinct(), "server", "left_semi")
        schema, keys, value, _ = DELTAS["playtime"]
        credits = playtime.credited_again(headers_of(whole), clients_of(whole), late.select("snapshot_id").distinct())
        missed = playtime.all_totals(credits).where(F.col(value) != 0)
        self._write(missed, "corrections", taken[-1])
        self._drop("late", taken[-1])
        return len(taken)

    def _next_states(self, headers: DataFrame, clients: DataFrame, before: DataFrame) -> DataFrame:
        """Last snapshot per server; client lists only for snapshots kept."""
        columns = ["ts", "snapshot_id", "map"]
        both = headers.select("server", *columns).unionByName(before.select("server", *columns))
        newest = (
            both.groupBy("server").agg(F.max(F.struct(*columns)).alias("_s"))
            .select("server", "_s.*")
        )
        lists = (
            first_occurrence(
                clients.select("snapshot_id", "ordinal", "player", "score", "in_game")
                .join(newest.select("snapshot_id"), "snapshot_id", "left_semi"))
            .groupBy("snapshot_id")
            .agg(F.collect_list(F.struct("ordinal", "player", "score", "in_game")).alias("clients"))
            .unionByName(before.select("snapshot_id", "clients"))
        )
        return newest.join(lists, "snapshot_id", "left").select(
            "server", "ts", "snapshot_id", "map", "clients")


def start_live(feed: DataFrame, tables: LiveTables, checkpoint: str,
               trigger: dict | None = None):
    """Run ``feed`` (deduplicated flat rows with ``rank_method``) into the tables."""
    tables.check_checkpoint(checkpoint)
    return (
        feed.writeStream.foreachBatch(tables.process)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def with_rank_method(feed: DataFrame, game_types: DataFrame) -> DataFrame:
    """Stream-static join to the rank method; unknown game types have none."""
    return feed.join(game_types.select("game_type", "rank_method"), "game_type", "left")
