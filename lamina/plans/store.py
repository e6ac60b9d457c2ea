"""The store: one logical table over a hot, a warm and a cold tier under one folder."""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import Future, ThreadPoolExecutor
from functools import reduce
from typing import Any, Protocol

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lamina.config import Config, load_config, logger
from lamina.functions.filters import time_bounds
from lamina.functions.moments import DAY as DAY_MICROS
from lamina.functions.moments import EPOCH, MICROSECOND, TEMPORAL, micros_of
from lamina.operators import audit, query as reading
from lamina.sources import tiers
from lamina.sources.manifest import TIERS, Entry, Manifest, ManifestFile
from lamina.sources.schema import SchemaError, conform, conform_arrow, nullable

Batch = DataFrame | pa.Table | pa.RecordBatch
#: An Arrow batch up to so many bytes is written from the driver, where it is; a larger one by a job.
DRIVER_BYTES = 32 << 20


class Tier(Protocol):
    """What every tier can be asked."""

    def ingest(self, batch: Batch) -> bool: ...

    def query(self, filters: Mapping[str, Any] | None = None, limit: int | None = None, sort_by: str | Sequence[str] | None = None, ascending: bool | Sequence[bool] = True) -> DataFrame: ...

    def get_stats(self) -> dict[str, Any]: ...


class StoreTier:
    """One tier of a store, as a Tier."""

    def __init__(self, store: Store, name: str):
        if name not in TIERS:
            raise ValueError(f"no tier {name!r}")
        self.store, self.name = store, name

    def ingest(self, batch: Batch) -> bool:
        """Appends to this tier, past the ones before it."""
        return self.store.ingest(batch, tier=self.name)

    def query(self, filters: Mapping[str, Any] | None = None, limit: int | None = None, sort_by: str | Sequence[str] | None = None, ascending: bool | Sequence[bool] = True) -> DataFrame:
        return reading.query(self.store.scan(filters, tiers_read=(self.name,)), filters, limit, sort_by, ascending, strict=self.store.config.query.strict)

    def get_stats(self) -> dict[str, Any]:
        return self.store.stats()[self.name]


class Store:
    """Append batches, move them through the tiers, query all of it as one table.

    One process writes to a store at a time (a second one that publishes is told so); any number may
    read, each seeing the manifest as it was when its query was made. With background=True data are
    moved on beside the ingest, which waits for that only where the hot tier is full.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, config: Config | None = None, merge_schema: bool = False, background: bool = False):
        self.spark, self.config, self.merge_schema = spark, config or load_config(), merge_schema
        self.path = (path or self.config.storage.base_path).rstrip("/")
        self.time_column = self.config.schema.time_column
        self._file = ManifestFile(spark, self.path)
        self._lock = threading.RLock()
        self._moving = threading.RLock()
        self._worker = ThreadPoolExecutor(1, "lamina-maintain") if background else None
        self._pending: Future | None = None
        self._pinned: dict[str, tuple[frozenset[str], DataFrame]] = {}
        self._streams: list[StreamingQuery] = []
        self._reads = 0
        self._log = logger(self.config)
        self._manifest = self._file.read()  # recovery is nothing more than this

    # --- writing

    def ingest(self, batch: Batch, origin: str | None = None, tier: str = "hot") -> bool:
        """Appends a batch to the hot tier, then moves older data on if the tier is over its budget.
        Durable once it returns. origin is "name:number" (or a name, for 0): a batch whose number is not
        above the last one of that name is not taken again, wherever its rows have moved since."""
        stream, _, number = (origin or "").rpartition(":")
        stream, number = (stream, int(number)) if stream and number.isdigit() else (origin, 0)
        if origin and number <= self._manifest.streams.get(stream, -1):
            return False
        if isinstance(batch, pa.RecordBatch):
            batch = pa.Table.from_batches([batch])
        with self._lock:
            self._manifest.sequence += 1
            number_of_batch = self._manifest.sequence
        name = f"{self.config.storage.landing_path}/{uuid.uuid4().hex}"
        if isinstance(batch, pa.Table) and batch.nbytes <= DRIVER_BYTES and tier == "hot":
            table, schema = conform_arrow(batch, self.schema, self.merge_schema)
            self._has_time(schema)
            held = number_of_batch if table.num_rows else None
            added = [Entry("hot", name, *self._write_arrow(table.append_column(tiers.BATCH, pa.repeat(number_of_batch, table.num_rows)), name), 0, first_batch=held, last_batch=held)]
        else:
            df = self.spark.createDataFrame(conform_arrow(batch, self.schema, self.merge_schema)[0]) if isinstance(batch, pa.Table) else batch
            df, schema = (df, nullable(df.schema.fields)) if self.schema is None else conform(df, self.schema, self.merge_schema)
            self._has_time(schema)
            added = self._write(df.withColumn(tiers.BATCH, F.lit(number_of_batch).cast("long")), schema, tier, name)
        with self._lock:
            self._manifest.schema = schema.json()
            self._manifest.sequence = max(self._manifest.sequence, number_of_batch)
            for e in added:
                e.sequence = number_of_batch
            if origin:
                self._manifest.streams[stream] = number
            self._publish([], added)
        if self._worker is None:
            self.maintain()
        elif self._pending is None or self._pending.done():
            self._settled()
            if self._over("hot") or self._over("warm") or self._small():
                self._pending = self._worker.submit(self.maintain)
        elif self._manifest.rows("hot") > self.config.hot_tier.max_records:
            self._settled()
        return True

    def maintain(self, aggressive: bool = False) -> None:
        """Merges small batches and moves data on while a tier is over its threshold; an aggressive call
        makes room in the warm tier earlier."""
        with self._moving:
            if small := self._small():
                self._rewrite_hot(small)
            while self._over("hot"):
                self.migrate("hot")
            if self._over("warm", aggressive):
                self.migrate("warm", rows=self._surplus())

    def migrate(self, tier: str, rows: int | None = None, on_step: Callable[[str], None] = lambda step: None) -> int:
        """Moves the oldest quarter of hot batches to warm (to cold if warm is off), or the warm days
        that were used least recently, until `rows` are freed, to cold. Returns the rows moved.

        The new files are written, then the manifest names them instead of the old ones, then those
        go. A crash in between loses nothing and doubles nothing. on_step is told of each step.
        """
        with self._moving:
            chosen = self._oldest_batches() if tier == "hot" else self._stale_days(rows)
            if not chosen:
                return 0
            to = "warm" if tier == "hot" and self.config.warm_tier.enabled else "cold"
            return self._move(chosen, self._read(chosen, batches=True), to, on_step)

    def compact(self, tier: str = "hot", least: int = 2) -> int:
        """Merges hot batches to one, the folders of each warm day to one, or all cold runs to one that
        is sorted as a whole, where there are at least so many. Returns the rows rewritten."""
        with self._moving:
            entries = self._manifest.of(tier)
            if tier == "hot":
                return self._rewrite_hot(entries) if len(entries) >= least else 0
            if tier == "warm":
                days: dict[str | None, list[Entry]] = {}
                for e in entries:
                    days.setdefault(e.day, []).append(e)
                entries = [e for own in days.values() if len(own) >= least for e in own]
            runs = [e for e in entries if not e.adopted]
            return self._move(runs, self._read(runs, batches=True), tier) if len(runs) >= least else 0

    def retain(self, latest: int, tier: str = "hot") -> int:
        """Deletes all but the latest batches, days or runs of a tier. What has moved on to another tier
        stays; see retain_batches(). Returns the rows deleted."""
        with self._moving, self._lock:
            gone = sorted(self._manifest.of(tier), key=lambda e: e.sequence, reverse=True)[max(0, latest) :]
            self._publish(gone, [])
            return sum(e.rows for e in gone)

    def retain_batches(self, latest: int) -> int:
        """Deletes all rows but those of the latest batches that hold any, whichever tier they lie in now
        and whatever they were merged with. Rows whose batch is not known (adopted files, files written
        before batches were) stay. Returns the rows deleted.

        Entries of older batches go as a whole; only those that hold newer rows too are rewritten."""
        with self._moving:
            entries = [e for t in TIERS for e in self._manifest.of(t) if e.last_batch]
            kept = sorted(self._latest_batches(entries, latest))
            # Later ones, of an ingest meanwhile, stay too.
            cut = kept[0] if kept else max((e.last_batch for e in entries), default=0) + 1
            older = [e for e in entries if e.first_batch < cut]
            mixed = [e for e in older if not 0 < e.first_batch <= e.last_batch < cut]
            stays = (F.col(tiers.BATCH) >= cut) | (F.col(tiers.BATCH) == 0)
            groups = [[e] for e in mixed if e.tier == "hot"] + [own for t in ("warm", "cold") if (own := [e for e in mixed if e.tier == t])]
            added: list[Entry] = []
            for own in groups:
                rows = self._read(own, batches=True).where(stays)
                new = self._write(rows, self.schema, own[0].tier, rows=sum(e.rows for e in own))
                if (written := sum(e.rows for e in new)) != (held := rows.count()):
                    raise RuntimeError(f"{held} rows were to stay and {written} were written; nothing was published")
                touched: dict[str | None, int] = {}
                for e in own:
                    touched[e.day] = max(e.touched, touched.get(e.day, 0))
                for e in new:
                    e.sequence, e.touched = max(old.sequence for old in own), touched.get(e.day, 0)
                added += new
            if older:
                self._publish(older, added)
            return sum(e.rows for e in older) - sum(e.rows for e in added)

    def adopt(self, *paths: str) -> None:
        """Adds Parquet files of an older layout to the cold tier, where they lie; they are counted."""
        if self.schema is None:
            self._manifest.schema = nullable(self.spark.read.parquet(*paths).schema.fields).json()
        added = [Entry("cold", p, *self._bounds(tiers.read_paths(self.spark, self.schema, [p])), self._manifest.sequence, adopted=True) for p in paths if p not in self._manifest.entries]
        self._publish([], added)

    def build_index(self, *columns: str) -> int:
        """Rewrites the cold runs that lack bloom filters on those columns, one at a time, each published
        when it is done. Returns the rows rewritten."""
        with self._moving:
            wanted = sorted({*self.config.cold_tier.bloom_filter_columns, *columns})
            self.config.cold_tier.bloom_filter_columns = wanted
            lacking = [e for e in self._manifest.of("cold") if not set(wanted) <= set(e.indexed)]
            return sum(self._move([e], self._read([e], batches=True), "cold") for e in lacking)

    def vacuum(self) -> list[str]:
        """Deletes folders that the manifest doesn't name: what a crash left, or a move that was cut
        short before its deletions. For when nobody reads by an older manifest. Returns their paths."""
        storage, gone = self.config.storage, []
        named = set(self._manifest.entries)
        roots = {"/".join(p.split("/")[:2]) for p in named}
        for folder in (storage.landing_path, storage.warm_path, storage.cold_path):
            for name in self._file.children(folder):
                path = f"{folder}/{name}"
                if path not in roots:
                    gone.append(path)
                elif folder == storage.warm_path:
                    gone += [day for d in self._file.children(path) if "=" in d and (day := f"{path}/{d}") not in named]
        for path in gone:
            self._file.remove(path)
        return gone

    # --- reading

    @property
    def schema(self) -> T.StructType | None:
        return T.StructType.fromJson(json.loads(self._manifest.schema)) if self._manifest.schema else None

    def tier(self, name: str) -> Tier:
        return StoreTier(self, name)

    def scan(self, filters: Mapping[str, Any] | None = None, tier_column: str | None = None, tiers_read: Sequence[str] = TIERS) -> DataFrame:
        """All tiers as one table. A range of times in the filters leaves out what the manifest proves
        empty, and becomes a partition filter of the cold tier; the filters themselves are not applied."""
        if self.schema is None:
            raise SchemaError("the store is empty")
        low, high = time_bounds(filters, self.time_column, self._time_type())
        out = None
        self._reads += 1
        for tier in tiers_read:
            entries = [e for e in self._manifest.of(tier) if e.overlaps(low, high)]
            if not entries:
                continue
            for e in entries:
                e.touched = self._reads
            part = self._pin_of(tier)
            if part is None:
                part = self._read(entries, low, high)
            if tier_column:
                part = part.withColumn(tier_column, F.lit(tier))
            out = part if out is None else out.unionByName(part)
        if out is None:
            empty = self.spark.createDataFrame([], self.schema)
            return empty.withColumn(tier_column, F.lit(None).cast("string")) if tier_column else empty
        return out

    def query(self, filters: Mapping[str, Any] | None = None, limit: int | None = None, sort_by: str | Sequence[str] | None = None, ascending: bool | Sequence[bool] = True, tie_break: Sequence[str] = (), columns: Sequence[str] | None = None, offset: int = 0) -> DataFrame:
        return reading.query(self.scan(filters), filters, limit, sort_by, ascending, tie_break, columns, self.config.query.strict, offset)

    def batches(self, *args: Any, **kwargs: Any) -> Iterator[pa.RecordBatch]:
        """query() as Arrow batches of the configured size, in order; the driver holds a partition of
        them at a time, and never makes a row of Python."""
        yield from reading.batches(self.query(*args, **kwargs), self.config.query.output_batch_size)

    def fast_lookup(self, column: str, value: Any) -> DataFrame:
        """Rows of one value: Parquet's statistics and bloom filters (see build_index) skip the rest."""
        return self.query({column: value})

    def pin(self, tier: str = "warm") -> DataFrame:
        """Keeps a tier in memory (and on local disks where it doesn't fit) until unpin() or close();
        queries read it from there while the tier's files are those that were pinned."""
        from pyspark import StorageLevel

        self.unpin(tier)
        entries = self._manifest.of(tier)
        frame = self._read(entries).persist(StorageLevel.MEMORY_AND_DISK)
        self._pinned[tier] = frozenset(e.path for e in entries), frame
        return frame

    def unpin(self, tier: str) -> None:
        if tier in self._pinned:
            self._pinned.pop(tier)[1].unpersist()

    # --- knowing

    def stats(self, files: bool = False) -> dict[str, Any]:
        """Per tier: rows, entries, days, share of capacity, times; all from the manifest. With files,
        also bytes and files, as the file system has them."""
        capacity = {"hot": self.config.hot_tier.max_records, "warm": self.config.warm_tier.max_records}
        out: dict[str, Any] = {}
        for tier in TIERS:
            entries = self._manifest.of(tier)
            rows = self._manifest.rows(tier)
            low = min((e.min_time for e in entries if e.min_time is not None), default=None)
            high = max((e.max_time for e in entries if e.max_time is not None), default=None)
            out[tier] = {
                "total_records": rows,
                "entries": len(entries),
                "partitions": len({e.day or (e.min_time or 0) // DAY_MICROS for e in entries}),
                "capacity_pct": 100 * rows / capacity[tier] if capacity.get(tier) else None,
                "min_time": None if low is None else EPOCH + low * MICROSECOND,
                "max_time": None if high is None else EPOCH + high * MICROSECOND,
            }
            if files:
                used = [self._file.usage(e.path) for e in entries]
                out[tier] |= {"bytes": sum(u[0] for u in used), "files": sum(u[1] for u in used)}
        return out | {"total_records": sum(out[t]["total_records"] for t in TIERS)}

    def audit(self, sent: DataFrame, key: str) -> DataFrame:
        """One row (sent, found, missing, duplicates)."""
        return audit.report(sent, self.scan().select(key), key)

    def audit_tiers(self) -> DataFrame:
        """Tiers whose rows differ from what the manifest says."""
        reported = self.spark.createDataFrame([(t, self._manifest.rows(t)) for t in TIERS if self._manifest.rows(t)], "tier string, total_records long")
        return audit.reported_against_actual(reported, self.scan(tier_column="tier"))

    def refresh(self) -> None:
        """Sees what another process has published."""
        with self._lock:
            self._manifest = self._file.read()

    def watch(self, stream: StreamingQuery) -> StreamingQuery:
        """wait() then also waits for what that stream has read."""
        self._streams.append(stream)
        return stream

    def wait(self) -> None:
        """Returns when streams have taken what was there, and background moves are done."""
        for stream in self._streams:
            if stream.isActive:
                stream.processAllAvailable()
        self._settled()

    def close(self) -> None:
        self.wait()
        if self._worker is not None:
            self._worker.shutdown()
        for tier in list(self._pinned):
            self.unpin(tier)

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *exc: object) -> None:
        self.close()

    # --- details

    def _at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def _time_type(self) -> T.DataType | None:
        return next((f.dataType for f in self.schema.fields if f.name == self.time_column), None)

    def _has_time(self, schema: T.StructType) -> None:
        kind = next((f.dataType for f in schema.fields if f.name == self.time_column), None)
        if not isinstance(kind, TEMPORAL):
            raise SchemaError(f"no time column {self.time_column!r}" if kind is None else f"column {self.time_column!r} holds no times, but {kind.simpleString()}")

    def _settled(self) -> None:
        """Waits for a background move; raises what it raised."""
        if (pending := self._pending) is not None:
            pending.result()
            self._pending = None

    def _over(self, tier: str, aggressive: bool = False) -> bool:
        hot, warm, rows = self.config.hot_tier, self.config.warm_tier, self._manifest.rows(tier)
        if tier == "hot":
            return rows > hot.eviction_threshold_pct * hot.max_records and rows > 0
        return warm.enabled and rows > (warm.aggressive_pct if aggressive else warm.eviction_threshold_pct) * warm.max_records

    def _surplus(self) -> int:
        """Rows to free so that the warm tier is at its target, and not too few."""
        warm = self.config.warm_tier
        return max(self._manifest.rows("warm") - int(warm.target_pct * warm.max_records), int(warm.least_pct * warm.max_records))

    def _small(self) -> list[Entry]:
        """Batches to merge: those under the size to merge to, once they hold as much together."""
        size = self.config.hot_tier.merge_rows
        small = [e for e in self._manifest.of("hot") if e.rows < size]
        return small if len(small) > 1 and sum(e.rows for e in small) >= size else []

    def _paths(self, entries: Sequence[Entry]) -> list[str]:
        return [e.path if e.adopted else self._at(e.path) for e in entries]

    def _latest_batches(self, entries: Sequence[Entry], latest: int) -> list[int]:
        """So many of the highest batches of entries: the manifest knows those of unmixed ones."""
        found = {e.first_batch for e in entries if e.first_batch == e.last_batch}
        several = [e for e in entries if e.first_batch != e.last_batch]
        if several and latest > 0:
            parts = [self._read(own, batches=True).select(tiers.BATCH) for t in TIERS if (own := [e for e in several if e.tier == t])]
            rows = reduce(DataFrame.unionByName, parts).distinct().orderBy(F.desc(tiers.BATCH)).limit(latest)
            found |= {r[0] for r in rows.collect()}
        return sorted(found - {0}, reverse=True)[: max(0, latest)]

    def _read(self, entries: Sequence[Entry], low: int | None = None, high: int | None = None, batches: bool = False) -> DataFrame:
        """The rows of entries of one tier; with batches, beside the batch of each, 0 where it is not known."""
        runs = [e for e in entries if e.tier == "cold" and not e.adopted]
        plain = [e for e in entries if e.tier != "cold" or e.adopted]
        schema = self._with_batch(self.schema) if batches else self.schema
        parts = [tiers.read_cold(self.spark, schema, self._at(self.config.storage.cold_path), self._paths(runs), low, high)] if runs else []
        parts += [tiers.read_paths(self.spark, schema, self._paths(plain))] if plain or not runs else []
        out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return out.withColumn(tiers.BATCH, F.coalesce(tiers.BATCH, F.lit(0))) if batches else out

    def _pin_of(self, tier: str) -> DataFrame | None:
        paths, frame = self._pinned.get(tier, (None, None))
        return frame if paths == frozenset(e.path for e in self._manifest.of(tier)) else None

    def _write(self, df: DataFrame, schema: T.StructType, tier: str, name: str | None = None, rows: int = 0) -> list[Entry]:
        """Writes rows (so many, where that is known) as new files of a tier: the entries for them."""
        storage, sequence = self.config.storage, self._manifest.sequence
        if tier == "warm":
            folder = f"{storage.warm_path}/{uuid.uuid4().hex}"
            tiers.write_days(df, self._at(folder), self.time_column, self.config.cold_tier)
            return self._days(folder, schema, sequence)
        if tier == "cold":
            name = f"{storage.cold_path}/{tiers.RUN}={uuid.uuid4().hex}"
            seen = Observation()
            tiers.write_cold(df, self._at(name), self.time_column, self.config.cold_tier, seen, [*self._measures(schema), *self._batches()], rows)
            found = seen.get
            return [Entry("cold", name, found["rows"], found["low"], found["high"], sequence, indexed=list(self.config.cold_tier.bloom_filter_columns), first_batch=found["first"], last_batch=found["last"])]
        name, seen = name or f"{storage.landing_path}/{uuid.uuid4().hex}", Observation()
        tiers.write_batch(df.observe(seen, *self._measures(schema), *self._batches()), self._at(name))
        found = seen.get  # measured while writing
        return [Entry("hot", name, found["rows"], found["low"], found["high"], sequence, first_batch=found["first"], last_batch=found["last"])]

    def _write_arrow(self, table: pa.Table, name: str) -> tuple[int, int | None, int | None]:
        """Writes a batch that the driver holds, without a job: (rows, first and last time)."""
        sink = pa.BufferOutputStream()
        pq.write_table(table, sink, compression=self.config.cold_tier.compression, coerce_timestamps="us", allow_truncated_timestamps=True)
        self._file.write(f"{name}/part-0.parquet", sink.getvalue().to_pybytes())
        times = table[self.time_column]
        if pa.types.is_date(times.type):
            low, high = (None if x.as_py() is None else (x.cast(pa.int32()).as_py()) * DAY_MICROS for x in pc.min_max(times).values())
        else:
            low, high = (x.as_py() for x in pc.min_max(times.cast(pa.timestamp("us", times.type.tz)).cast(pa.int64())).values())
        return table.num_rows, low, high

    def _publish(self, gone: Sequence[Entry], added: Sequence[Entry], on_step: Callable[[str], None] = lambda step: None) -> None:
        """The manifest names the new files instead of the old ones, then those go."""
        with self._lock:
            try:
                self._manifest.replace(gone, added)
                self._file.publish(self._manifest)
            except BaseException:
                self.refresh()
                raise
        on_step("published")
        for e in gone:
            if not e.adopted:
                self._file.remove(e.path)
        # Days lie in the folder of the move that wrote them, which goes with the last of them.
        named = {p.rpartition("/")[0] for p in list(self._manifest.entries)}
        for folder in {e.path.rpartition("/")[0] for e in gone if e.tier == "warm" and not e.adopted} - named:
            if folder.startswith(f"{self.config.storage.warm_path}/"):
                self._file.remove(folder)

    def _move(self, chosen: Sequence[Entry], source: DataFrame, to: str, on_step: Callable[[str], None] = lambda step: None) -> int:
        with self._lock:
            self._manifest.sequence += 1
        added = self._write(source, self.schema, to, rows=sum(e.rows for e in chosen))
        if (moved := sum(e.rows for e in added)) != (held := sum(e.rows for e in chosen)):
            raise RuntimeError(f"{held} rows were to move and {moved} arrived; nothing was published")
        on_step("written")
        self._publish(chosen, added, on_step)
        self._log.info("moved %s rows from %s to %s", moved, chosen[0].tier, to)
        return moved

    def _rewrite_hot(self, entries: Sequence[Entry]) -> int:
        added = self._write(self._read(entries, batches=True), self.schema, "hot")
        for e in added:
            e.sequence = min(old.sequence for old in entries)
        self._publish(entries, added)
        return sum(e.rows for e in added)

    def _measures(self, schema: T.StructType) -> list[Column]:
        time, kind = F.col(f"`{self.time_column}`"), schema[self.time_column].dataType
        return [F.count(F.lit(1)).alias("rows"), *(micros_of(f(time), kind).alias(n) for n, f in (("low", F.min), ("high", F.max)))]

    def _batches(self) -> list[Column]:
        return [F.min(tiers.BATCH).alias("first"), F.max(tiers.BATCH).alias("last")]

    def _with_batch(self, schema: T.StructType) -> T.StructType:
        return T.StructType([*schema.fields, T.StructField(tiers.BATCH, T.LongType())])

    def _bounds(self, df: DataFrame) -> tuple[int, int | None, int | None]:
        rows, low, high = df.agg(*self._measures(df.schema)).first()
        return rows, low, high

    def _days(self, folder: str, schema: T.StructType, sequence: int) -> list[Entry]:
        """An entry for each day of a folder that write_days wrote; there are as many rows as days."""
        wide = T.StructType([*self._with_batch(schema).fields, T.StructField(tiers.DAY, T.StringType())])
        days = self.spark.read.schema(wide).parquet(self._at(folder)).groupBy(tiers.DAY).agg(*self._measures(schema), *self._batches()).collect()
        return [Entry("warm", f"{folder}/{tiers.DAY}={d[0]}", d[1], d[2], d[3], sequence, day=d[0], first_batch=d[4], last_batch=d[5]) for d in sorted(days)]

    def _oldest_batches(self) -> list[Entry]:
        batches = sorted(self._manifest.of("hot"), key=lambda e: (e.min_time is not None, e.min_time or 0, e.sequence))
        return batches[: max(1, len(batches) // 4)] if batches else []

    def _stale_days(self, rows: int | None) -> list[Entry]:
        """Warm days, those first that no query has read for longest, and of these the oldest."""
        days = sorted(self._manifest.of("warm"), key=lambda e: (e.touched, e.max_time is not None, e.max_time or 0, e.sequence))
        need, chosen = self._manifest.rows("warm") if rows is None else rows, []
        freed = 0
        for e in days:
            if freed >= need:
                break
            chosen.append(e)
            freed += e.rows
        return chosen


def open_store(spark: SparkSession, path: str, time_column: str = "timestamp", background: bool = False, **overrides: Mapping[str, Any]) -> Store:
    """A store with default settings but for overrides, given by section."""
    return Store(spark, path, load_config(overrides={"schema": {"time_column": time_column}, **overrides}), background=background)


__all__ = ["Manifest", "Store", "Tier", "open_store"]
