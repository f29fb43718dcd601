"""Collections on disk: a log in Parquet, a manifest per generation, statistics per unit.

Layout of a collection's folder:

    descriptor.json             dimensions, metric, thresholds
    CURRENT                     number of the newest manifest
    manifests/<generation>.json checkpoint and units; never rewritten
    commits/<last seq>.json     a batch counts once this file exists; its size and where it came from
    delta/<first seq>/          operations of a batch
    units/unit_id=<id>/         operations of an immutable unit
    stats/, histograms/         per unit and field, written with the unit
    indexes/unit_id=<id>/       the unit's visible records by list, and <id>.json beside it

Data is written first and the small file that names it last, so what a crash
leaves behind is never read.  A batch is atomic.  One driver writes a collection.
"""

from __future__ import annotations

import math
import threading
import uuid
from collections import defaultdict
from collections.abc import Iterable, Sequence
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import asdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillvec.model import (
    INDEXED, LOG, MUTABLE_UNIT, VECTOR, BarrierNotSatisfied, CommitAck, Descriptor, DimensionMismatch, EmptyBatch, InvalidArgument, InvalidSnapshot, NotFound, Scalar, Snapshot,
)
from quillvec.operators import ann, mvcc
from quillvec.operators.predicate import Predicate, combine, validate
from quillvec.plans import engine, planner, stats
from quillvec.sources.files import Files

_LOCKS: defaultdict[str, threading.RLock] = defaultdict(threading.RLock)
Operation = tuple  # ("put", id, vector, metadata JSON) or ("delete", id)


class Collection:
    """An open collection.

    With `background` a thread does what maintenance writes ask for, and what was left
    pending when the collection was last open; else the write that asks for it does it.
    """

    def __init__(self, spark: SparkSession, path: str, background: bool = False):
        self.spark, self.files = spark, Files(spark, path)
        if not self.files.exists("descriptor.json"):
            raise NotFound(f"no collection at {path}")
        self.descriptor = Descriptor(**self.files.read("descriptor.json"))
        self.lock = _LOCKS[self.files.root]
        self.worker = ThreadPoolExecutor(1, "maintenance") if background else None
        self.runs: list[Future] = []
        if background:
            self.runs.append(self.worker.submit(self.maintain))

    @classmethod
    def create(cls, spark: SparkSession, path: str, descriptor: Descriptor) -> Collection:
        files = Files(spark, path)
        files.write("manifests/0.json", {"generation": 0, "checkpoint_seq_no": 0, "units": []})
        files.write("CURRENT", 0)
        files.write("descriptor.json", asdict(descriptor))
        return cls(spark, path)

    # --- boundaries -----------------------------------------------------------------------

    def manifest(self, generation: int | None = None) -> dict:
        generation = self.files.read("CURRENT") if generation is None else generation
        if not self.files.exists(f"manifests/{generation}.json"):
            raise InvalidSnapshot(f"invalid snapshot: no generation {generation}")
        return self.files.read(f"manifests/{generation}.json")

    def last_seq_no(self) -> int:
        commits = [int(n.removesuffix(".json")) for n in self.files.names("commits") if n.endswith(".json")]
        return max([self.manifest()["checkpoint_seq_no"], *commits])

    def snapshot(self) -> Snapshot:
        return Snapshot(self.manifest()["generation"], self.last_seq_no())

    def resolve(self, snapshot: Snapshot | None = None, read_barrier: Snapshot | None = None) -> Snapshot:
        """The boundary to read at: the one asked for if valid, or the current one if past the barrier."""
        if snapshot is not None and read_barrier is not None:
            raise InvalidArgument("snapshot and read barrier exclude each other")
        current = self.snapshot()
        if read_barrier is not None and not current.satisfies(read_barrier):
            raise BarrierNotSatisfied(f"at {current}, barrier {read_barrier}")
        if snapshot is None:
            return current
        if not self.manifest(snapshot.generation)["checkpoint_seq_no"] <= snapshot.visible_seq_no <= current.visible_seq_no:
            raise InvalidSnapshot(f"invalid snapshot: {snapshot}")
        return snapshot

    def commits(self, manifest: dict) -> list[dict]:
        """Batches after a manifest's checkpoint, oldest first."""
        names = [n for n in self.files.names("commits") if n.endswith(".json") and int(n.removesuffix(".json")) > manifest["checkpoint_seq_no"]]
        return [self.files.read(f"commits/{n}") for n in names]

    # --- reads ----------------------------------------------------------------------------

    def log(self, snapshot: Snapshot | None = None) -> DataFrame:
        """All operations visible at a snapshot, with `unit_id`; whole units and batches are pruned by path."""
        at = self.resolve(snapshot)
        manifest = self.manifest(at.generation)
        parts = []
        if manifest["units"]:
            paths = [self.files.at(f"units/unit_id={u['unit_id']}") for u in manifest["units"]]
            parts.append(self.spark.read.option("basePath", self.files.at("units")).schema(f"{ddl(LOG)}, unit_id string").parquet(*paths))
        delta = [self.files.at(f"delta/{c['first']}") for c in self.commits(manifest) if c["first"] <= at.visible_seq_no]
        if delta:
            parts.append(self.spark.read.schema(ddl(LOG)).parquet(*delta).where(F.col("seq_no") > manifest["checkpoint_seq_no"]).withColumn("unit_id", F.lit(MUTABLE_UNIT)))
        if not parts:
            return self.spark.createDataFrame([], f"{ddl(LOG)}, unit_id string")
        whole = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return whole.where(F.col("seq_no") <= at.visible_seq_no)

    def scan(self, snapshot: Snapshot | None = None, units: Sequence[str] | None = None, include_mutable: bool = True) -> DataFrame:
        return mvcc.scan(self.log(snapshot), None, units, include_mutable)

    def lookup(self, ids: Iterable[str] | DataFrame, snapshot: Snapshot | None = None) -> DataFrame:
        wanted = ids if isinstance(ids, DataFrame) else self.spark.createDataFrame([(i,) for i in ids], "id string")
        return mvcc.lookup(self.log(snapshot), wanted)

    def unit_statistics(self, snapshot: Snapshot, names: set[str], keys: set[str]) -> list[stats.UnitStats]:
        """Statistics for planning: written ones of immutable units, fresh ones of the mutable unit."""
        manifest, log = self.manifest(snapshot.generation), self.log(snapshot)
        units = [stats.UnitStats(u["unit_id"], "immutable", u["index_kind"], u["min_seq_no"], u["max_seq_no"], u["put_count"], u["delete_count"], u["approx_bytes"]) for u in manifest["units"]]
        by_id = {u.unit_id: u for u in units}
        if units and names:
            chosen = F.col("field").isin(*names) & F.col("unit_id").isin(*by_id)
            paths = [self.files.at(f"stats/unit_id={u}") for u in by_id]
            for r in self.spark.read.option("basePath", self.files.at("stats")).parquet(*paths).where(chosen).collect():
                by_id[r["unit_id"]].fields[r["field"]] = stats.FieldStats(r["present_count"], r["null_count"], r["distinct_count"], stats.scalar_of(r["least"]), stats.scalar_of(r["most"]), {}, r["string_count"], r["number_count"], r["scalar_count"])
            if keys:
                paths = [self.files.at(f"histograms/unit_id={u}") for u in by_id]
                for r in self.spark.read.option("basePath", self.files.at("histograms")).parquet(*paths).where(chosen & F.col("value_key").isin(*keys)).collect():
                    by_id[r["unit_id"]].fields[r["field"]].counts[r["value_key"]] = r["n"]
        mutable = log.where(F.col("unit_id") == MUTABLE_UNIT)
        fresh = stats.planning_stats(mutable, names, keys, {})
        return units + (fresh or [stats.UnitStats(MUTABLE_UNIT, "mutable", "raw", 0, 0, 0, 0)])

    def query(
        self, vector: Sequence[float], top_k: int, *, filters: dict[str, Scalar] | None = None, predicate: Predicate | None = None, snapshot: Snapshot | None = None,
        read_barrier: Snapshot | None = None, explain: str = "none", precision: str = "f32",
    ) -> engine.Result:
        """The best `top_k` visible records that satisfy filters and predicate."""
        if len(vector) != self.descriptor.dimensions:
            raise DimensionMismatch(f"query vector dimension mismatch: expected {self.descriptor.dimensions}, found {len(vector)}")
        whole = combine(filters, predicate)
        if whole is not None:
            validate(whole)
        at = self.resolve(snapshot, read_barrier)
        units = self.unit_statistics(at, *planner.named(whole))
        return engine.execute(
            self.log(at), units, vector, self.descriptor.metric, top_k, dimensions=self.descriptor.dimensions, predicate=whole, precision=precision, explain=explain, index=lambda chosen, wide: self.indexed(chosen, vector, wide)
        )

    def indexed(self, units: Sequence[str], vector: Sequence[float], wide: float = 1.0) -> tuple[DataFrame, bool]:
        """The indexed records of units that a query for `vector` has to look at, with `unit_id`; other lists are not opened.

        `wide`: how many times the usual lists to read.  Also whether these are all lists.
        """
        paths, whole = [], True
        for unit in units:
            index = ann.Index(**self.files.read(f"indexes/{unit}.json"))
            probes = math.ceil(index.probes * wide)
            whole = whole and probes >= len(index.centroids)
            there = {int(n.removeprefix("list=")) for n in self.files.names(f"indexes/unit_id={unit}")}
            paths += [self.files.at(f"indexes/unit_id={unit}/list={k}") for k in ann.probed(vector, np.array(index.centroids), self.descriptor.metric, probes) if k in there]
        schema = f"{ddl(INDEXED)}, unit_id string, list int"
        lists = self.spark.read.option("basePath", self.files.at("indexes")).schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return lists, whole

    def stats(self, snapshot: Snapshot | None = None, read_barrier: Snapshot | None = None) -> dict:
        at = self.resolve(snapshot, read_barrier)
        row = stats.collection_stats(self.log(at)).first()
        units = self.unit_statistics(at, set(), set())
        return {"snapshot": at, "live_count": row["live_count"], "deleted_count": row["deleted_count"], "mutable_ops": row["mutable_ops"], "segment_count": len(units) - 1, "units": units}

    def inspect(self, target: str, unit_id: str | None = None) -> DataFrame | dict:
        """`manifest`, `wal` (operations of the mutable unit), `maintenance`, or `segment` with its id."""
        if target == "manifest":
            return self.manifest()
        if target == "maintenance":
            return self.maintenance_status()
        if target == "wal":
            return self.log().where(F.col("unit_id") == MUTABLE_UNIT).orderBy("seq_no")
        if target == "segment":
            if unit_id not in {u["unit_id"] for u in self.manifest()["units"]}:
                raise NotFound(f"no segment {unit_id!r}")
            return self.log().where(F.col("unit_id") == unit_id).orderBy("seq_no")
        raise InvalidArgument(f"cannot inspect {target!r}")

    # --- writes ---------------------------------------------------------------------------

    def write(self, operations: Iterable[Operation] | DataFrame, ord_col: str = "ord", stream: tuple[str, int] | None = None) -> CommitAck:
        """Append a batch, all or nothing.

        A list is applied in its order; a DataFrame `(op, id, vector, metadata)` in
        the order of `ord_col`.  No id may occur twice.  The input is evaluated once:
        what is checked is what is written.  `stream`, a name and a number, is kept
        with the commit; a number that the stream has reached is not written again.
        """
        if not isinstance(operations, DataFrame):
            rows = [(k, o[0], o[1], [float(x) for x in o[2]] if o[0] == "put" else None, (o[3] if len(o) > 3 else "{}") if o[0] == "put" else None) for k, o in enumerate(operations)]
            operations = self.spark.createDataFrame(rows, "ord long, op string, id string, vector array<float>, metadata string")
        batch = operations.select(F.col(ord_col).alias("ord"), "op", "id", F.col("vector").cast(VECTOR.simpleString()), "metadata")
        staging = f"staging/{uuid.uuid4().hex}"
        try:
            dealt = batch.repartitionByRange("ord").withColumn("_range", F.spark_partition_id())
            dealt.write.parquet(self.files.at(staging))
            staged = self.spark.read.schema(dealt.schema).parquet(self.files.at(staging))
            sizes = self.checked(staged)
            with self.lock:
                manifest, last = self.manifest(), self.last_seq_no()
                if stream is not None and stream[1] <= self.stream_number(stream[0]):
                    return CommitAck(last, 0, self.snapshot())
                self.numbered(staged, last).write.mode("overwrite").parquet(self.files.at(f"delta/{last + 1}"))
                entry = {"first": last + 1, "last": last + sizes["ops"], **sizes, "stream": None if stream is None else list(stream)}
                self.files.write(f"commits/{entry['last']:020d}.json", entry)
                if self.worker is None:
                    self.maintain()
                elif label := self.due():
                    self.enqueue(label)
                    self.runs.append(self.worker.submit(self.maintain))
                return CommitAck(entry["last"], sizes["ops"], self.snapshot())
        finally:
            self.files.delete(staging)

    def checked(self, batch: DataFrame) -> dict[str, int]:
        """How many operations and bytes `batch` holds; an error if it must not be written."""
        put = F.col("op") == "put"
        known = F.col("op").isin("put", "delete") & F.coalesce(F.col("id") != "", F.lit(False))
        row = batch.agg(
            F.count("*").alias("n"), F.count_if(~F.coalesce(known, F.lit(False))).alias("bad"), F.count_if(put & F.coalesce(F.size("vector") != self.descriptor.dimensions, F.lit(True))).alias("sizes"),
            F.count_if(put & F.try_parse_json(F.coalesce("metadata", F.lit(""))).isNull()).alias("json"), F.coalesce(F.sum(stats.approx_bytes()), F.lit(0)).alias("bytes"),
        ).first()
        if not row["n"]:
            raise EmptyBatch("a batch must not be empty")
        if row["bad"]:
            raise InvalidArgument("operations must be put or delete, with an id")
        if row["sizes"]:
            raise DimensionMismatch(f"expected vectors of {self.descriptor.dimensions} dimensions")
        if row["json"]:
            raise InvalidArgument("metadata must be JSON")
        if twice := batch.groupBy("id").count().where("count > 1").limit(1).collect():
            raise InvalidArgument(f"duplicate record id {twice[0]['id']!r} in a batch")
        return {"ops": row["n"], "bytes": row["bytes"]}

    def numbered(self, staged: DataFrame, last: int) -> DataFrame:
        """`staged` with sequence numbers in order, without one task seeing all rows.

        Rows were dealt by ranges of `ord`; a range's numbers start after the sizes
        of the ranges before it.
        """
        sizes = staged.groupBy("_range").count()
        before = sizes.withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
        own = F.row_number().over(Window.partitionBy("_range").orderBy("ord"))
        return staged.withColumn("_own", own).join(F.broadcast(before), "_range").select((F.lit(last) + F.col("_before") + F.col("_own")).cast("long").alias("seq_no"), "op", "id", "vector", "metadata")

    def stream_number(self, name: str) -> int:
        """The last batch number of a stream that is committed, or -1."""
        manifest = self.manifest()
        later = [c["stream"][1] for c in self.commits(manifest) if c.get("stream") and c["stream"][0] == name]
        return max([manifest.get("streams", {}).get(name, -1), *later])

    def publish(self, units: list[dict], checkpoint: int) -> None:
        before = self.manifest()
        generation, streams = before["generation"] + 1, dict(before.get("streams", {}))
        for c in self.commits(before):
            if c.get("stream") and c["last"] <= checkpoint:
                streams[c["stream"][0]] = max(streams.get(c["stream"][0], -1), c["stream"][1])
        self.files.write(f"manifests/{generation}.json", {"generation": generation, "checkpoint_seq_no": checkpoint, "units": units, "streams": streams})
        self.files.write("CURRENT", generation)

    def write_unit(self, operations: DataFrame) -> dict:
        """A new immutable unit from log rows, with its statistics and its index."""
        unit = str(uuid.uuid4())
        path = self.files.at(f"units/unit_id={unit}")
        operations.select(*LOG.fieldNames()).repartitionByRange("seq_no").sortWithinPartitions("seq_no").write.parquet(path)
        rows = self.spark.read.schema(ddl(LOG)).parquet(path).withColumn("unit_id", F.lit(unit))
        stats.field_stats(rows).drop("unit_id").write.parquet(self.files.at(f"stats/unit_id={unit}"))
        stats.field_histogram(rows).drop("unit_id").write.parquet(self.files.at(f"histograms/unit_id={unit}"))
        index = ann.build(rows, self.files.at(f"indexes/unit_id={unit}"), self.descriptor.metric, self.descriptor.dimensions)
        self.files.write(f"indexes/{unit}.json", asdict(index))
        if index.kind == ann.RAW:
            self.files.delete(f"indexes/unit_id={unit}")
        counts = stats.unit_counts(rows).first().asDict()
        return counts | {"unit_id": unit, "index_kind": index.kind, "component_bytes": self.component_bytes(unit)}

    def component_bytes(self, unit: str) -> dict[str, int]:
        """Bytes on disk of a unit's parts."""
        return {part: self.files.size(f"{part}/unit_id={unit}") for part in ("units", "stats", "histograms", "indexes")}

    def flush(self) -> bool:
        """Freeze the mutable unit; False if it is empty."""
        with self.lock:
            manifest, last = self.manifest(), self.last_seq_no()
            if last == manifest["checkpoint_seq_no"]:
                return False
            unit = self.write_unit(self.log().where(F.col("unit_id") == MUTABLE_UNIT))
            self.publish([*manifest["units"], unit], last)
            return True

    def compact(self) -> bool:
        """Merge immutable units, keeping the newest operation on each id; False if there is at most one."""
        with self.lock:
            manifest = self.manifest()
            if len(manifest["units"]) <= 1:
                return False
            unit = self.write_unit(mvcc.compact_image(self.log()))
            self.publish([unit], manifest["checkpoint_seq_no"])
            return True

    # --- maintenance ----------------------------------------------------------------------

    def due(self) -> str | None:
        """What the thresholds ask for: `flush`, `compact` or nothing."""
        manifest = self.manifest()
        batches = self.commits(manifest)
        if sum(c["ops"] for c in batches) >= self.descriptor.flush_ops or sum(c["bytes"] for c in batches) >= self.descriptor.flush_bytes:
            return "flush"
        return "compact" if len(manifest["units"]) >= self.descriptor.compact_units else None

    def maintenance_status(self) -> dict:
        if not self.files.exists("maintenance.json"):
            return {"pending": [], "in_progress": None, "last_error": None, "completed_runs": 0}
        return self.files.read("maintenance.json")

    def enqueue(self, label: str) -> None:
        status = self.maintenance_status()
        if label not in status["pending"] and label != status["in_progress"]:
            self.files.write("maintenance.json", status | {"pending": [*status["pending"], label]})

    def maintain(self) -> None:
        """Run what is due or was left pending, one after another; errors are kept in the status."""
        with self.lock:
            status = self.maintenance_status()
            if status["in_progress"]:
                self.files.write("maintenance.json", status | {"in_progress": None, "pending": [status["in_progress"], *status["pending"]]})
            while True:
                if label := self.due():
                    self.enqueue(label)
                status = self.maintenance_status()
                if not status["pending"]:
                    return
                label, *rest = status["pending"]
                self.files.write("maintenance.json", status | {"pending": rest, "in_progress": label})
                try:
                    {"flush": self.flush, "compact": self.compact}[label]()
                    done = {"last_error": None, "completed_runs": status["completed_runs"] + 1}
                except Exception as e:
                    self.files.write("maintenance.json", self.maintenance_status() | {"in_progress": None, "last_error": str(e)})
                    return
                self.files.write("maintenance.json", self.maintenance_status() | {"in_progress": None} | done)


    def drain(self) -> None:
        """Wait until the background thread has nothing left to do."""
        while self.runs:
            self.runs.pop(0).result()

    def vacuum(self, keep_generations: int = 1) -> dict[str, int]:
        """Delete what only generations before the newest `keep_generations` can read; snapshots of those become invalid."""
        with self.lock:
            newest = self.manifest()["generation"]
            kept = [self.manifest(g) for g in range(max(0, newest - keep_generations + 1), newest + 1) if self.files.exists(f"manifests/{g}.json")]
            checkpoint, units = min(m["checkpoint_seq_no"] for m in kept), {u["unit_id"] for m in kept for u in m["units"]}
            gone = {"manifests": 0, "commits": 0, "units": 0}
            for n in self.files.names("manifests"):
                if int(n.removesuffix(".json")) < kept[0]["generation"]:
                    self.files.delete(f"manifests/{n}")
                    gone["manifests"] += 1
            for n in self.files.names("commits"):
                if int(n.removesuffix(".json")) <= checkpoint:
                    self.files.delete(f"delta/{self.files.read(f'commits/{n}')['first']}")
                    self.files.delete(f"commits/{n}")
                    gone["commits"] += 1
            for n in self.files.names("units"):
                unit = n.removeprefix("unit_id=")
                if unit not in units:
                    for part in ("units", "stats", "histograms", "indexes"):
                        self.files.delete(f"{part}/unit_id={unit}")
                    self.files.delete(f"indexes/{unit}.json")
                    gone["units"] += 1
            return gone


def ddl(schema) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
