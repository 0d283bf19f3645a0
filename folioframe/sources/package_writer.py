"""Source packages as a Spark data source: a folder a package, named by the digest of what it holds, that appears whole or not at all."""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: The version of how packages are made, and the manifest's name and schema.
TRANSFORM, MANIFEST, SCHEMA = "source-package/1", "source_document.json", "source-package/0.1"
COLUMNS = ("package", "component", "ord", "line")
DDL = "package string, component string, ord long, line string"


def folder_of(path: str) -> str:
    """A folder that the driver and all executors mount; other stores than files have no renames that are whole or nothing, and are refused."""
    scheme, _, rest = path.partition("://")
    if rest and scheme != "file":
        raise ValueError(f"packages are written to a mounted folder, not to {scheme}")
    return "/" + rest.lstrip("/") if rest else path


def version_of(components: dict[str, dict]) -> str:
    """Twelve signs of the digest of the components' names, digests and the way they are made."""
    told = "|".join([TRANSFORM, *(f"{name}:{c['sha256']}" for name, c in sorted(components.items()))])
    return hashlib.sha256(told.encode()).hexdigest()[:12]


@dataclass
class Written(WriterCommitMessage):
    """What one task has made: hidden folders and the names they are to get."""

    packages: list[tuple[str, str]] = field(default_factory=list)


class PackageWriter(DataSourceWriter):
    """Each task writes its packages into hidden folders of its own; the commit renames them.

    A task that is lost, or runs twice, leaves hidden folders that no message names: the commit removes those
    of this job. A package that is there already under its version stays as it is, so a second run changes nothing.
    """

    def __init__(self, folder: str):
        self.folder = folder
        self.job = uuid.uuid4().hex[:12]

    def write(self, rows: Iterator[Row]) -> Written:
        out = Written()
        name, made = None, None
        for row in rows:
            if row.package != name:
                if made:
                    out.packages.append(made.close())
                name, made = row.package, _Folder(self.folder, self.job, row.package)
            made.add(row.component, row.line)
        if made:
            out.packages.append(made.close())
        return out

    def commit(self, messages: list[Written | None]) -> None:
        for hidden, name in sorted(p for m in messages if m for p in m.packages):
            target = os.path.join(self.folder, name)
            if os.path.isdir(target):
                shutil.rmtree(hidden)
                continue
            try:
                os.rename(hidden, target)
            except OSError:  # another job was first
                if not os.path.isdir(target):
                    raise
                shutil.rmtree(hidden)
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        for name in os.listdir(self.folder) if os.path.isdir(self.folder) else ():
            if name.startswith(f".{self.job}-"):
                shutil.rmtree(os.path.join(self.folder, name), ignore_errors=True)


class _Folder:
    """One package on its way: a component is open at a time, its digest and size kept while it is written."""

    def __init__(self, folder: str, job: str, package: str):
        self.package = package
        self.path = os.path.join(folder, f".{job}-{uuid.uuid4().hex}")
        os.makedirs(self.path)
        self.components: dict[str, dict] = {}
        self.file = None

    def add(self, component: str, line: str | None) -> None:
        if component not in self.components:
            if os.path.basename(component) != component or component.startswith(".") or component == MANIFEST:
                raise ValueError(f"not a name of a component: {component}")
            self._end()
            self.components[component] = {"path": component, "sha256": hashlib.sha256(), "bytes": 0, "records": 0}
            self.name, self.file = component, open(os.path.join(self.path, component), "wb")
        elif component != self.name:
            raise ValueError("a component's lines must stand together")
        data = (line or "").encode() + b"\n"
        self.file.write(data)
        record = self.components[component]
        record["sha256"].update(data)
        record["bytes"] += len(data)
        record["records"] += 1

    def _end(self) -> None:
        if self.file:
            self.file.flush()
            os.fsync(self.file.fileno())
            self.file.close()
            self.components[self.name]["sha256"] = self.components[self.name]["sha256"].hexdigest()

    def close(self) -> tuple[str, str]:
        self._end()
        version = version_of(self.components)
        manifest = {"package_schema": SCHEMA, "transform": TRANSFORM, "package": self.package, "version": version, "components": self.components}
        with open(os.path.join(self.path, MANIFEST), "w", encoding="utf-8") as out:
            out.write(json.dumps(manifest, ensure_ascii=False, sort_keys=True))
            out.flush()
            os.fsync(out.fileno())
        return self.path, f"{self.package}.source.{version}"


class PackageSource(DataSource):
    """`folio_package`: rows of package, component, ord and line, a package's rows in one task and in order."""

    @classmethod
    def name(cls) -> str:
        return "folio_package"

    def schema(self) -> str:
        return DDL

    def writer(self, schema: StructType, overwrite: bool) -> PackageWriter:
        if overwrite:
            raise ValueError("packages are added, never overwritten")
        if tuple(schema.fieldNames()) != COLUMNS:
            raise ValueError(f"columns must be {', '.join(COLUMNS)}")
        folder = folder_of(self.options["path"])
        with contextlib.suppress(FileExistsError):
            os.makedirs(folder)
        return PackageWriter(folder)


def write_packages(lines: DataFrame, folder: str, package: str = "package", component: str = "component", order: str = "ord", line: str = "line") -> None:
    """Write packages: a folder `<package>.source.<version>` each, with a file a component and a manifest of sizes, digests and records.

    package must be a safe name of a folder. Lines without text are empty ones. Running again with the same lines changes
    nothing; other lines of a package make another version beside it.
    """
    spark = lines.sparkSession
    spark.dataSource.register(PackageSource)
    safe = F.when(F.col(package).rlike(r"^[\w][\w.-]*$"), F.col(package)).otherwise(F.raise_error(F.concat(F.lit("not a name of a package: "), F.coalesce(F.col(package), F.lit("null")))))
    rows = lines.select(safe.alias("package"), F.col(component).alias("component"), F.col(order).cast("long").alias("ord"), F.col(line).alias("line"))
    rows.repartition("package").sortWithinPartitions("package", "component", "ord", "line").write.format("folio_package").option("path", folder).mode("append").save()


def package_components(spark: SparkSession, folder: str) -> DataFrame:
    """(package, version, component, bytes, records, sha256) of the packages of a folder, by their manifests; hidden folders are none."""
    record = "struct<path:string,sha256:string,bytes:long,records:long>"
    schema = f"package string, version string, components map<string,{record}>"
    base = folder if "://" in folder else f"file://{folder}"
    found = spark.read.schema(schema).json(f"{base}/*.source.*/{MANIFEST}")
    return found.select("package", "version", F.explode("components").alias("component", "c")).select("package", "version", "component", "c.bytes", "c.records", "c.sha256")


def damaged(spark: SparkSession, folder: str) -> DataFrame:
    """(package, version, component) whose file is not there or not what the manifest says."""
    base = folder if "://" in folder else f"file://{folder}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{base}/*.source.*")
    parts = F.regexp_extract("path", r"/([^/]+)\.source\.([0-9a-f]{12})/([^/]+)$", 1), F.regexp_extract("path", r"\.source\.([0-9a-f]{12})/", 1), F.regexp_extract("path", r"([^/]+)$", 1)
    now = files.select(parts[0].alias("package"), parts[1].alias("version"), parts[2].alias("component"), F.sha2("content", 256).alias("now"))
    told = package_components(spark, folder)
    return told.join(now, ["package", "version", "component"], "left").where(~F.col("sha256").eqNullSafe(F.col("now"))).select("package", "version", "component")
