"""Sharding by size-tiered compaction under a versioned manifest.

Arrivals are appended as they come, as small immutable Parquet shards in a run folder of
their own. Shards of like size form a tier; once a tier has FANOUT of them they are
merged, without a shuffle, into files of about the target size. A version is a manifest
that names its parts, each a list of shards; a commit writes parts for what is new and
names the others again. It becomes current by one atomic rename that fails where another
writer was first.

Readers of a version never see a half-written state, and a lost executor costs only the
tasks it ran. What a failed or crashed writer leaves is in no manifest, disturbs nobody,
and is removed by vacuum once it is old. Old versions stay readable until then.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

TARGET_BYTES = 128 << 20
#: Like-sized shards that are merged together, and the ratio between tiers.
FANOUT = 4
#: Bytes of the smallest tier's upper end.
SMALLEST = 1 << 20
#: Rows of an arrival's shards at most, to keep them small.
ARRIVAL_ROWS = 20_000
#: Shards that one part of a manifest names at most.
PART_SHARDS = 10_000
#: Commits tried again after other writers came first.
ATTEMPTS = 20
#: Seconds that versions, and files no version names, are kept by vacuum.
KEEP_SECONDS = 7 * 24 * 3600
CODEC = "zstd"


@dataclass(frozen=True)
class Shard:
    """path is relative to the store's root: run folder and file; of is the run's number of files."""

    path: str
    bytes: int
    of: int

    @property
    def run(self) -> str:
        return self.path.rsplit("/", 1)[0]


@dataclass(frozen=True)
class Part:
    """A file of shards, and the least bytes of them."""

    name: str
    shards: int
    least: int


class OtherColumns(ValueError):
    """An arrival's column clashes with one of the store."""


class Conflict(RuntimeError):
    """Another writer committed this version first."""


class ShardStore:
    """Shards and manifests below one root folder of any Hadoop file system.

    The file system's rename is reached through the JVM gateway, which Spark has no
    public call for; so a store is opened on a classic session.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(self._conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        self._no_overwrite = spark.sparkContext._gateway.new_array(
            jvm.org.apache.hadoop.fs.Options.Rename, 0
        )

    def _files(self, folder: str) -> Iterator[tuple[str, int, float]]:
        """(name, bytes, seconds since it was written) of what is in a folder."""
        p = self._path(f"{self.root}/{folder}")
        if self._fs.exists(p):
            now = time.time()
            for s in self._fs.listStatus(p):
                yield s.getPath().getName(), s.getLen(), now - s.getModificationTime() / 1000

    def _read(self, name: str) -> dict:
        source = self._fs.open(self._path(f"{self.root}/manifests/{name}"))
        try:
            return json.loads(bytes(source.readAllBytes()).decode())
        finally:
            source.close()

    def _put(self, name: str, content: dict) -> None:
        out = self._fs.create(self._path(f"{self.root}/manifests/{name}"), False)
        out.write(json.dumps(content).encode())
        out.close()

    def versions(self) -> list[int]:
        """Committed versions that vacuum has left, ascending."""
        names = (n for n, _, _ in self._files("manifests"))
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def version(self) -> int:
        """Current version, 0 before the first commit."""
        return max(self.versions(), default=0)

    def parts(self, version: int | None = None) -> list[Part]:
        version = self.version() if version is None else version
        return [Part(**p) for p in self._read(f"v{version:08d}.json")["parts"]] if version else []

    def schema(self, version: int | None = None) -> StructType:
        """Columns of a version: those of all arrivals up to it."""
        version = self.version() if version is None else version
        return StructType.fromJson(self._read(f"v{version:08d}.json")["schema"]) if version else StructType()

    def shards(self, version: int | None = None) -> list[Shard]:
        return [s for p in self.parts(version) for s in self._shards(p)]

    def _shards(self, part: Part) -> list[Shard]:
        return [Shard(**x) for x in self._read(part.name)["shards"]]

    def _new_parts(self, shards: list[Shard]) -> list[Part]:
        out = []
        for i in range(0, len(shards), PART_SHARDS):
            some = shards[i : i + PART_SHARDS]
            name = f"part-{uuid.uuid4().hex}.json"
            self._put(name, {"shards": [asdict(s) for s in some]})
            out.append(Part(name, len(some), min(s.bytes for s in some)))
        return out

    def commit(self, base: int, parts: list[Part], schema: StructType) -> int:
        """Makes parts and columns version base + 1, or raises Conflict and changes nothing."""
        new, draft = base + 1, f".draft-{uuid.uuid4().hex}"
        self._put(draft, {"version": new, "schema": schema.jsonValue(), "parts": [asdict(p) for p in parts]})
        source, target = (self._path(f"{self.root}/manifests/{n}") for n in (draft, f"v{new:08d}.json"))
        try:
            self._context.rename(source, target, self._no_overwrite)
        except Py4JJavaError as e:
            self._fs.delete(source, False)
            if self._fs.exists(target):
                raise Conflict(f"version {new} exists") from e
            raise
        return new

    def _write(self, df: DataFrame, rows: int | None) -> list[Shard]:
        """Writes df as a new run, whose name no other writer can choose."""
        run = f"runs/r{self.version() + 1:08d}-{uuid.uuid4().hex}"
        out = df.write.option("compression", CODEC)
        if rows:
            out = out.option("maxRecordsPerFile", rows)
        out.parquet(f"{self.root}/{run}")
        files = sorted((n, size) for n, size, _ in self._files(run) if n.startswith("part-"))
        return [Shard(f"{run}/{n}", size, len(files)) for n, size in files]

    def append(self, df: DataFrame, rows: int = ARRIVAL_ROWS) -> int:
        """Adds an arrival: every task writes its rows as shards of at most `rows`.

        Where other writers commit first, the same shards are added to their version.
        Columns new to the store are added to it.
        """
        all_columns(self.schema(), df.schema)
        new = self._new_parts(self._write(df, rows))
        for _ in range(ATTEMPTS):
            base = self.version()
            columns = all_columns(self.schema(base), df.schema)
            try:
                return self.commit(base, self.parts(base) + new, columns)
            except Conflict:
                continue
        raise Conflict(f"{ATTEMPTS} other writers came first")

    def compact(self, target: int = TARGET_BYTES, fanout: int = FANOUT) -> int:
        """Merges tiers until none has fanout shards below half the target; one commit a merge.

        Only parts with such a shard are read and written anew. A merge that another
        writer overtook is planned again; what it wrote is left to vacuum.
        """
        lost = 0
        while True:
            base = self.version()
            parts = self.parts(base)
            opened = {p.name: self._shards(p) for p in parts if 2 * p.least < target}
            merged = set(due([s for some in opened.values() for s in some], target, fanout))
            if not merged:
                return base
            size = sum(s.bytes for s in merged)
            columns = self.schema(base)
            new = self._write(self._load(merged, columns).coalesce(max(1, math.ceil(size / target))), None)
            touched = {n for n, some in opened.items() if merged & set(some)}
            left = [s for n in touched for s in opened[n] if s not in merged]
            try:
                self.commit(base, [p for p in parts if p.name not in touched] + self._new_parts(left + new), columns)
            except Conflict:
                lost += 1
                if lost >= ATTEMPTS:
                    raise

    def vacuum(self, keep_seconds: float = KEEP_SECONDS) -> int:
        """Drops versions but the current one, and files that no version names, of that age.

        Files of writers that have not committed are younger than any job may run, so
        keep_seconds must exceed that. Returns the number of data files deleted.
        """
        current = self.version()
        old = {n for n, _, age in self._files("manifests") if age > keep_seconds}
        for v in self.versions():
            if v != current and f"v{v:08d}.json" in old:
                self._fs.delete(self._path(f"{self.root}/manifests/v{v:08d}.json"), False)
        kept = {p for v in self.versions() for p in self.parts(v)}
        named = {s.path for p in kept for s in self._shards(p)}
        for n in old - {p.name for p in kept} - {f"v{v:08d}.json" for v in self.versions()}:
            self._fs.delete(self._path(f"{self.root}/manifests/{n}"), False)
        gone = 0
        for run, _, _ in list(self._files("runs")):
            files = [(f"runs/{run}/{n}", age) for n, _, age in self._files(f"runs/{run}")]
            dead = [f for f, age in files if f not in named and age > keep_seconds]
            if files and len(dead) == len(files):
                self._fs.delete(self._path(f"{self.root}/runs/{run}"), True)
            else:
                for f in dead:
                    self._fs.delete(self._path(f"{self.root}/{f}"), False)
            gone += sum("/part-" in f for f in dead)
        return gone

    def _load(self, shards: Iterable[Shard], schema: StructType) -> DataFrame:
        """Rows of shards, in all columns; a run of which all files are asked for is read as a folder."""
        shards = list(shards)
        asked = Counter(s.run for s in shards)
        paths = sorted({s.run if asked[s.run] == s.of else s.path for s in shards})
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{p}" for p in paths])

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, with the shard each stands in."""
        version = self.version() if version is None else version
        shards = self.shards(version)
        if not shards:
            raise ValueError("the store is empty")
        name = F.regexp_extract("_metadata.file_path", r"runs/[^/]+/[^/]+$", 0)
        return self._load(shards, self.schema(version)).withColumn("shard", name)


def all_columns(known: StructType, given: StructType) -> StructType:
    """Columns of both, all nullable, the known ones first; raises OtherColumns where they clash."""
    out = {f.name.lower(): f for f in known}
    for f in given:
        before = out.setdefault(f.name.lower(), StructField(f.name, f.dataType, True, f.metadata))
        if before.name != f.name or before.dataType != f.dataType:
            raise OtherColumns(f"{f.name} {f.dataType.simpleString()} beside {before.name} {before.dataType.simpleString()}")
    return StructType(list(out.values()))


def tier(size: int, fanout: int) -> int:
    """0 up to SMALLEST bytes, then one more for each factor of fanout."""
    return 0 if size <= SMALLEST else math.ceil(math.log(size / SMALLEST, fanout) - 1e-9)


def due(shards: list[Shard], target: int, fanout: int) -> list[Shard]:
    """Shards of the lowest tier that has fanout shards smaller than half the target."""
    tiers: defaultdict[int, list[Shard]] = defaultdict(list)
    for s in shards:
        if 2 * s.bytes < target:
            tiers[tier(s.bytes, fanout)].append(s)
    full = [t for t in sorted(tiers) if len(tiers[t]) >= fanout]
    return tiers[full[0]] if full else []


def short_name(shard: Column) -> Column:
    """Run number, task and file of a shard; alike in every rerun, if only one writer writes."""
    return F.regexp_replace(shard, r"^runs/(r\d+)-[^/]*/(part-\d+)-[^/]*?(-c\d+)?\.[^/]*$", "$1/$2$3")


def shard_table(df: DataFrame, root: str, target: int = TARGET_BYTES, fanout: int = FANOUT) -> DataFrame:
    """Appends df to the store at root, compacts it, and reads the new version.

    All rows and columns come back, nulls, long texts and repeated rows among them,
    with the column shard (replaced, if df has one). An empty df adds an empty shard.
    """
    store = ShardStore(df.sparkSession, root)
    store.append(df.drop("shard"))
    store.compact(target, fanout)
    return store.read()
