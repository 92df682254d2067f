"""Shards by size-tiered compaction with a versioned manifest (operator 9)."""

from __future__ import annotations

import json
import math
from collections import defaultdict

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C


class Conflict(RuntimeError):
    """Another writer committed this version first."""


class ShardStore:
    """Immutable Parquet shards below ``path``, and manifests that name those of each version.

    A reader sees the version of the last manifest: either all of a commit or nothing of it. Files that no manifest
    names are remains of a failed attempt, and are ignored.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.path}/manifests"))
        C.ship(spark)

    def version(self) -> int:
        """The last committed version; 0 is the empty store."""
        return max([int(x.getPath().getName().split(".")[0]) for x in self._fs.listStatus(self._path(f"{self.path}/manifests")) if x.getPath().getName()[0] not in "._"], default=0)

    def manifest(self, version: int | None = None) -> dict:
        """``version``, ``shards`` (each with number, file, rows and bytes), the ``next`` number and ``schema``."""
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "next": 0, "shards": [], "schema": None}
        fs, at = pafs.FileSystem.from_uri(f"{self.path}/manifests/{version:09d}.json")
        with fs.open_input_stream(at) as f:
            return json.loads(f.read())

    def commit(self, base: dict, kept: list[dict], new: list[dict], schema: str) -> int:
        """Publish the version after the manifest ``base`` by one rename, which fails if that version exists. New shards are numbered on."""
        version, number = base["version"] + 1, base["next"]
        shards = kept + [{"number": number + i, **s} for i, s in enumerate(new)]
        final = self._path(f"{self.path}/manifests/{version:09d}.json")
        temp = self._path(f"{self.path}/manifests/.{version:09d}.{id(self)}")
        out = self._fs.create(temp, True)
        out.write(bytearray(json.dumps({"version": version, "next": number + len(new), "shards": shards, "schema": schema}).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(temp, final):
            self._fs.delete(temp, False)
            raise Conflict(f"version {version} exists")
        return version

    def append(self, df: DataFrame, rows_each: int = 4096) -> int:
        """Add rows as small shards of at most ``rows_each`` rows, as they arrive: no exchange."""
        now = self.manifest()
        folder = C.fresh_path(self.spark, "x").rsplit("/", 1)[1]
        at = f"{self.path}/shards/{folder}"
        df.write.option("maxRecordsPerFile", rows_each).parquet(at)
        files = {x.getPath().getName(): x.getLen() for x in self._fs.listStatus(self._path(at)) if x.getPath().getName().endswith(".parquet")}
        counts = {}
        if files:
            seen = self.spark.read.schema(df.schema).parquet(at).groupBy(F.col("_metadata.file_name").alias("f")).agg(F.count("*").alias("n"))
            counts = {r.f: r.n for r in seen.collect()}
        new = [{"file": f"shards/{folder}/{n}", "rows": counts[n], "bytes": size} for n, size in sorted(files.items()) if counts.get(n)]
        return self.commit(now, now["shards"], new, df.schema.json())

    @staticmethod
    def plan(shards: list[dict], target: int, fan_in: int, base: float) -> list[list[dict]]:
        """Runs to merge: of shards below ``target``, those within a factor ``base`` in size are a tier; a tier of at least ``fan_in``
        is cut into runs of about the target size."""
        tiers = defaultdict(list)
        for s in shards:
            if s["bytes"] < target * 3 // 4:
                tiers[int(math.log(max(1, s["bytes"]), base))].append(s)
        runs = []
        for _, tier in sorted(tiers.items()):
            if len(tier) < fan_in:
                continue
            tier = sorted(tier, key=lambda s: (s["bytes"], s["file"]))
            wanted = max(1, round(sum(s["bytes"] for s in tier) / target))
            each = sum(s["bytes"] for s in tier) / wanted
            run, size, done = [], 0, 0
            for s in tier:
                run.append(s)
                size += s["bytes"]
                if size >= each * 0.999 and done < wanted - 1:
                    runs.append(run)
                    run, size, done = [], 0, done + 1
            if run:
                runs.append(run)
        return [r for r in runs if len(r) > 1]

    def compact(self, target: int = 128 << 20, fan_in: int = 4, base: float = 4.0) -> int:
        """Merge until no tier has ``fan_in`` shards. Each run is one task that streams its shards into one file: rows aren't exchanged,
        and a task that runs again writes the same name."""
        while runs := self.plan((now := self.manifest())["shards"], target, fan_in, base):
            version, path = now["version"] + 1, self.path

            def merge(batches):
                for batch in batches:
                    for number, files in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                        fs, root = pafs.FileSystem.from_uri(path)
                        fs.create_dir(f"{root}/shards/v{version:09d}", recursive=True)
                        name = f"shards/v{version:09d}/{number:09d}.parquet"
                        temp = f"{root}/shards/v{version:09d}/.{number:09d}.{TaskContext.get().taskAttemptId()}"
                        rows, out = 0, None
                        for f in files:
                            source = pq.ParquetFile(fs.open_input_file(f"{root}/{f}"))
                            for part in source.iter_batches(batch_size=2048):
                                out = out or pq.ParquetWriter(fs.open_output_stream(temp), part.schema, compression="zstd", compression_level=1)
                                out.write_batch(part, row_group_size=8192)
                                rows += len(part)
                        out.close()
                        fs.move(temp, f"{root}/{name}")
                        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([rows], pa.int64()), pa.array([fs.get_file_info(f"{root}/{name}").size], pa.int64())], names=["file", "rows", "bytes"])

            work = self.spark.createDataFrame([(i, [s["file"] for s in r]) for i, r in enumerate(runs)], "number int, files array<string>")
            made = [r.asDict() for r in work.repartitionByRange(len(runs), "number").mapInArrow(merge, "file string, rows long, bytes long").collect()]
            gone = {s["file"] for r in runs for s in r}
            if sum(m["rows"] for m in made) != sum(s["rows"] for r in runs for s in r):
                raise RuntimeError("merged shards hold other numbers of rows than their sources")
            self.commit(now, [s for s in now["shards"] if s["file"] not in gone], sorted(made, key=lambda m: m["file"]), now["schema"])
        return self.version()

    def vacuum(self, keep: int = 1) -> int:
        """Delete shards that none of the last ``keep`` versions names, and older manifests; returns how many files went."""
        last = self.version()
        named = {s["file"] for v in range(max(1, last - keep + 1), last + 1) for s in self.manifest(v)["shards"]}
        old = {s["file"] for v in range(1, last - keep + 1) if self._fs.exists(self._path(f"{self.path}/manifests/{v:09d}.json")) for s in self.manifest(v)["shards"]} - named
        for f in sorted(old):
            self._fs.delete(self._path(f"{self.path}/{f}"), False)
        for v in range(1, last - keep + 1):
            self._fs.delete(self._path(f"{self.path}/manifests/{v:09d}.json"), False)
        return len(old)

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version, or None if nothing was ever appended."""
        from pyspark.sql.types import StructType

        now = self.manifest(version)
        if now["schema"] is None:
            return None
        schema = StructType.fromJson(json.loads(now["schema"]))
        if not now["shards"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{s['file']}" for s in now["shards"]])


def shard_documents(df: DataFrame, target: int = 128 << 20, rows_each: int = 4096, fan_in: int = 4, id_col: str = "doc_id", path: str | None = None) -> DataFrame:
    """``(doc_id, shard, version)``: the shard of each row in the committed version, after appending ``df`` as small arrivals and
    compacting these.

    All columns are stored, whatever they hold: nulls, empty and long texts and repeated rows are kept as they
    are. No rows in, a version without shards, and no rows out.
    """
    spark = df.sparkSession
    store = ShardStore(spark, path or C.fresh_path(spark, "shards"))
    store.append(df, rows_each)
    version = store.compact(target, fan_in)
    store.vacuum()
    shards = store.manifest()["shards"]
    numbers = spark.createDataFrame([(s["file"], s["number"]) for s in shards], "file string, shard long")
    if not shards:
        return numbers.select(F.col("shard").alias("doc_id"), "shard", F.lit(version).alias("version"))
    rows = store.read().select(F.col(id_col).cast("long").alias("doc_id"), F.regexp_extract(F.col("_metadata.file_path"), "shards/[^/]+/[^/]+$", 0).alias("file"))
    return rows.join(numbers, "file").select("doc_id", "shard", F.lit(version).alias("version"))
