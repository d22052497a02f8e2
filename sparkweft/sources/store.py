"""Facts at rest: Parquet files dealt by unit bucket, replaced unit by unit."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweft import model
from sparkweft.operators import merge
from sparkweft.session import durable
from sparkweft.sources.facts import Facts

#: Tables that hold what units report; a unit's rows lie in one bucket of each.
TABLES = {"unit": model.TU, "symbol": model.RAW_SYMBOL, "edge": model.RAW_EDGE, "include": model.RAW_INCLUDE, "diag": model.RAW_DIAG}
SCHEMAS = TABLES | {"file": model.FILE, "meta": "key string, value string"}


class StoreConflict(RuntimeError):
    """Another writer committed meanwhile; nothing of this write counts."""


class Store:
    """Tables under one path that every executor reaches.

    A version is one small manifest that lists the folders of every table and bucket. A write makes
    new folders for the buckets that its units fall into, and for nothing else, then commits its
    manifest under the next number, which can be made only once: of two writers that began from one version the
    second fails. Readers of earlier versions are not disturbed and a failed write changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    # --- versions --------------------------------------------------------------------------------

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _names(self, path: str) -> list[str]:
        fs, at = self._fs(path)
        return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []

    def _numbers(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names(f"{self.path}/versions") if n.endswith(".json") and n[:-5].isdigit())

    def _manifest(self, number: int) -> dict | None:
        fs, at = self._fs(f"{self.path}/versions/{number}.json")
        source = fs.open(at)
        try:
            text = bytes(source.readAllBytes()).decode()
        finally:
            source.close()
        try:
            return json.loads(text)
        except ValueError:
            return None  # cut off by a crash: never committed

    def current(self) -> tuple[int, dict]:
        """(version, manifest): tables to folders by bucket, and the version that the merged symbols stand for."""
        for number in reversed(self._numbers()):
            if (found := self._manifest(number)) is not None:
                return number, found
        return 0, {"tables": {}, "data": 0, "merged": None}

    def version(self) -> int:
        return self.current()[0]

    def _commit(self, seen: list[int], manifest: dict) -> None:
        fs, at = self._fs(f"{self.path}/versions/{max(seen, default=0) + 1}.json")
        try:
            out = fs.create(at, False)
        except Exception as e:
            raise StoreConflict(f"version {max(seen, default=0) + 1} of {self.path} exists already") from e
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()

    # --- tables ----------------------------------------------------------------------------------

    def _read(self, name: str, folders: Iterable[str]) -> DataFrame:
        paths = [f"{self.path}/{f}" for f in folders]
        return self.spark.read.schema(SCHEMAS[name]).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMAS[name])

    def table(self, name: str) -> DataFrame:
        folders = self.current()[1]["tables"].get(name, {})
        return self._read(name, (f for own in folders.values() for f in own))

    def _bucket(self):
        return F.pmod(F.xxhash64("tu"), F.lit(self.buckets)).cast("int")

    def _write(self, name: str, rows: DataFrame) -> dict[str, list[str]]:
        """bucket to folders of what was written."""
        base = f"{name}/{uuid.uuid4().hex}"
        if name in TABLES:
            rows.withColumn("bucket", self._bucket()).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{base}")
            return {n.removeprefix("bucket="): [f"{base}/{n}"] for n in self._names(f"{self.path}/{base}") if n.startswith("bucket=")}
        rows.write.parquet(f"{self.path}/{base}")
        return {"all": [base]}

    def _replace(self, units: DataFrame, parts: dict[str, DataFrame], files: DataFrame | None) -> None:
        seen = self._numbers()
        _, manifest = self.current()
        units = durable(units.select("tu").distinct())
        touched = [str(r[0]) for r in units.select(self._bucket().alias("b")).distinct().collect()]  # at most as many as there are buckets
        tables = {n: dict(t) for n, t in manifest["tables"].items()}
        for name in TABLES:
            own = tables.setdefault(name, {})
            kept = self._read(name, (f for b in touched for f in own.pop(b, []))).join(units, "tu", "left_anti")
            own |= self._write(name, kept.unionByName(parts[name].select(kept.columns)) if name in parts else kept)
        if files is not None:
            # what a file is was decided when it was first seen, so files are only added
            new = self._write("file", files.join(self.table("file").select("path"), "path", "left_anti"))
            tables["file"] = {"all": [*tables.get("file", {}).get("all", []), *new["all"]]}
        self._commit(seen, manifest | {"tables": tables, "data": manifest["data"] + 1})

    def ingest(self, facts: Facts) -> None:
        """Replace the facts of the units at hand, whole: what a unit no longer reports is gone."""
        parts = {"unit": facts.units, "symbol": facts.symbols, "edge": facts.edges, "include": facts.includes, "diag": facts.diagnostics}
        self._replace(facts.units, parts, facts.files)

    def drop(self, units: DataFrame) -> None:
        self._replace(units, {}, None)

    # --- merged symbols --------------------------------------------------------------------------

    def _merged(self) -> DataFrame:
        files = self.table("file").withColumn("file_id", F.col("path"))
        raw = self.table("symbol").withColumnsRenamed({"file": "file_id", "def_file": "def_file_id", "tu": "tu_id"})
        return merge.merge_symbols(raw, files)

    def rebuild_symbols(self) -> None:
        """Write one record a symbol, for readers to take instead of merging again."""
        seen = self._numbers()
        _, manifest = self.current()
        base = f"merged/{uuid.uuid4().hex}"
        self._merged().write.parquet(f"{self.path}/{base}")
        self._commit(seen, manifest | {"merged": [manifest["data"], base]})

    def symbols(self) -> DataFrame:
        """One record a symbol: as written, if nothing was ingested since, else merged on the way."""
        _, manifest = self.current()
        merged = manifest.get("merged")
        return self.spark.read.parquet(f"{self.path}/{merged[1]}") if merged and merged[0] == manifest["data"] else self._merged()

    # --- metadata and stamps ---------------------------------------------------------------------

    def meta(self) -> DataFrame:
        return self.table("meta")

    def set_meta(self, **values: str) -> None:
        """Only the metadata is written, a few rows."""
        seen = self._numbers()
        _, manifest = self.current()
        new = self.spark.createDataFrame([(k, str(v)) for k, v in values.items()], SCHEMAS["meta"])
        rows = self.meta().join(new.select("key"), "key", "left_anti").unionByName(new)
        self._commit(seen, manifest | {"tables": manifest["tables"] | {"meta": self._write("meta", rows.coalesce(1))}})

    def get_meta(self, key: str) -> str | None:
        found = self.meta().where(F.col("key") == key).select("value").first()
        return found[0] if found else None

    def stale(self, stamps: DataFrame) -> DataFrame:
        """Of units (tu, stamp, ...) those whose stamp is new or differs from the stored one."""
        known = self.table("unit").select(F.col("tu").alias("of"), F.col("stamp").alias("as"))
        return stamps.join(known, (F.col("tu") == F.col("of")) & (F.col("stamp") == F.col("as")), "left_anti")

    def compact(self, keep: int = 2, delete: Callable[[str], None] | None = None) -> list[str]:
        """Folders that none of the last ``keep`` versions names; deleted by the given function."""
        named = set()
        for number in self._numbers()[-keep:]:
            manifest = self._manifest(number) or {"tables": {}, "merged": None}
            named |= {f for t in manifest["tables"].values() for own in t.values() for f in own} | ({manifest["merged"][1]} if manifest["merged"] else set())
        held = [f"{t}/{made}" + (f"/{b}" if t in TABLES else "") for t in (*SCHEMAS, "merged") for made in self._names(f"{self.path}/{t}")
                for b in ([n for n in self._names(f"{self.path}/{t}/{made}") if n.startswith("bucket=")] if t in TABLES else [""])]
        gone = [f"{self.path}/{f}" for f in held if f not in named]
        for g in gone if delete else ():
            delete(g)
        return gone
