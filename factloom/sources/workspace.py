"""A workspace of tables on disk: save, load, export, import, list, delete; JSON lines in and out."""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import zipfile
from datetime import datetime, timezone
from pathlib import Path, PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("facts", "chunks", "edges", "entities", "postings", "tags", "embeddings", "eval_report")
REQUIRED = ("manifest.json", "facts", "chunks", "edges", "entities", "tags")
FACT = T.StructType([T.StructField(c, T.StringType()) for c in ("subject", "predicate", "object", "value", "unit", "timeframe", "source_ref", "source_id", "chunk_id")] + [T.StructField("confidence", T.DoubleType()), T.StructField("seq", T.LongType())])


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of JSON lines; blank, broken and non-object lines are left out."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def graph_json(edges: DataFrame) -> DataFrame:
    """Node-link rows (kind, json): one line for each node and link, instead of one document for all."""
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().select(F.lit("node").alias("kind"), F.to_json(F.struct("id")).alias("json"))
    links = edges.select(F.lit("link").alias("kind"), F.to_json(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), "label", "value", "unit", "timeframe", "source_ref", "confidence")).alias("json"))
    return nodes.unionByName(links)


def read_graph_json(rows: DataFrame) -> DataFrame:
    """Edges (src, dst, label, ...) out of node-link rows."""
    link = F.from_json("json", "struct<source: string, target: string, label: string, value: string, unit: string, timeframe: string, source_ref: string, confidence: double>")
    return rows.where("kind = 'link'").select(link.alias("l")).select(F.col("l.source").alias("src"), F.col("l.target").alias("dst"), "l.label", "l.value", "l.unit", "l.timeframe", "l.source_ref", "l.confidence")


def append_vectors(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old vectors and those new ones that have the same length; their positions go on."""
    shape = old.agg(F.max(F.size("embedding")).alias("dim"), F.coalesce(F.max("pos"), F.lit(-1)).alias("last"))
    fit = new.crossJoin(F.broadcast(shape)).where(F.col("dim").isNull() | (F.size("embedding") == F.col("dim")))
    return old.select("pos", "embedding").unionByName(fit.select((F.col("pos") + F.col("last") + 1).alias("pos"), "embedding"))


def merge_sources(old: DataFrame, new: DataFrame) -> DataFrame:
    """(n, name): the names of both in order, the first of each in any case."""
    both = old.select(F.lit(0).alias("part"), "n", "name").unionByName(new.select(F.lit(1).alias("part"), "n", "name")).where("name IS NOT NULL AND trim(name) != ''")
    first = both.groupBy(F.lower(F.trim("name")).alias("low")).agg(F.min(F.struct("part", "n", F.trim("name").alias("name"))).alias("f"))
    return first.select("f.part", "f.n", "f.name")


def first_free(wanted: str, taken: set[str]) -> str:
    """The wanted id, or the first of wanted-2, wanted-3, ... that isn't taken."""
    n, name = 2, wanted
    while name in taken:
        name, n = f"{wanted}-{n}", n + 1
    return name


class Workspace:
    """One directory for each workspace, with a Parquet table for each part and a manifest."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, Path(root)

    def path(self, rag_id: str) -> Path:
        if not rag_id or PurePosixPath(rag_id).name != rag_id or rag_id in (".", ".."):
            raise ValueError(f"no workspace id: {rag_id!r}")
        return self.root / rag_id

    def save(self, rag_id: str, tables: dict[str, DataFrame], name: str = "", profile: str = "balanced", models: dict | None = None, source_files: list[str] | None = None, now: str | None = None) -> dict:
        """Writes the tables given and a manifest with their counts; created_at and earlier source files are kept."""
        at = self.path(rag_id)
        at.mkdir(parents=True, exist_ok=True)
        old = self.manifest(rag_id) or {}
        counts = dict(old.get("counts", {}))
        for t, df in tables.items():
            if t not in TABLES:
                raise ValueError(f"no table of a workspace: {t}")
            df.write.mode("overwrite").parquet(str(at / t))
            counts[t] = self.spark.read.parquet(str(at / t)).count()
        now = now or datetime.now(timezone.utc).isoformat().replace("+00:00", "Z")
        files = {f.lower(): f for f in reversed([*old.get("source_files", []), *(source_files or [])])}
        manifest = {
            "format_version": "2.0", "rag_id": rag_id, "graph_name": name or old.get("graph_name", rag_id), "created_at": old.get("created_at", now), "updated_at": now,
            "build_profile": profile, "models": models or old.get("models", {}), "source_files": list(reversed(files.values())), "counts": counts,
        }
        (at / "manifest.json").write_text(json.dumps(manifest, indent=1))
        return manifest

    def manifest(self, rag_id: str) -> dict | None:
        p = self.path(rag_id) / "manifest.json"
        return json.loads(p.read_text()) if p.exists() else None

    def load(self, rag_id: str) -> dict[str, DataFrame]:
        """The tables that there are, lazily."""
        at = self.path(rag_id)
        return {t: self.spark.read.parquet(str(at / t)) for t in TABLES if (at / t).exists()}

    def list(self) -> list[dict]:
        """Manifests with disk_bytes, the last updated first."""
        out = []
        for p in sorted(self.root.iterdir()) if self.root.exists() else []:
            if (p / "manifest.json").exists():
                out.append(json.loads((p / "manifest.json").read_text()) | {"disk_bytes": sum(f.stat().st_size for f in p.rglob("*") if f.is_file())})
        return sorted(out, key=lambda m: m.get("updated_at", ""), reverse=True)

    def delete(self, rag_id: str) -> None:
        shutil.rmtree(self.path(rag_id), ignore_errors=True)

    def export_archive(self, rag_id: str, target: str) -> str:
        """A zip of the workspace; what it must have has to be there, and archives inside are left out."""
        at = self.path(rag_id)
        if lacking := [r for r in REQUIRED if not (at / r).exists()]:
            raise ValueError(f"the workspace lacks {', '.join(lacking)}")
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(at.rglob("*")):
                if f.is_file() and f.suffix != ".zip":
                    z.write(f, f.relative_to(at).as_posix())
        return target

    def import_archive(self, archive: str, wanted: str | None = None) -> str:
        """Unpacks an archive under a free id; members that lead out of it are refused."""
        with tempfile.TemporaryDirectory(dir=self._made()) as tmp, zipfile.ZipFile(archive) as z:
            for m in z.namelist():
                p = PurePosixPath(m.replace("\\", "/"))
                if p.is_absolute() or ".." in p.parts or (p.parts and ":" in p.parts[0]):
                    raise ValueError(f"unsafe member: {m}")
            z.extractall(tmp)
            base = next((Path(d) for d, _, files in os.walk(tmp) if "manifest.json" in files), None)
            if base is None or any(not (base / r).exists() for r in REQUIRED):
                raise ValueError("no workspace in the archive")
            manifest = json.loads((base / "manifest.json").read_text())
            rag_id = first_free(wanted or str(manifest.get("rag_id") or "workspace"), {p.name for p in self.root.iterdir()})
            shutil.copytree(base, self.path(rag_id))
        manifest |= {"rag_id": rag_id, "updated_at": datetime.now(timezone.utc).isoformat().replace("+00:00", "Z")}
        (self.path(rag_id) / "manifest.json").write_text(json.dumps(manifest, indent=1))
        return rag_id

    def _made(self) -> Path:
        self.root.mkdir(parents=True, exist_ok=True)
        return self.root


def catalog(files: DataFrame) -> DataFrame:
    """(rag_id, files, disk_bytes) of a listing (rag_id, length), as for workspaces on a distributed file system."""
    return files.groupBy("rag_id").agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("disk_bytes"))


def sessions(messages: DataFrame, most: int = 64) -> DataFrame:
    """(id, messages, title, updated_at) of messages (id, turn, role, content, at): the title is the first thing the user said."""
    user = F.when(F.col("role") == "user", F.col("content"))
    title = F.min_by(user, F.when(F.col("role") == "user", F.col("turn")))
    return messages.groupBy("id").agg(F.count(F.lit(1)).alias("messages"), F.coalesce(F.left(F.trim(title), F.lit(most)), F.lit("New Session")).alias("title"), F.max("at").alias("updated_at"))
