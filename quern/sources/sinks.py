"""Writers and manifests. Spark's commit protocol publishes a directory as a whole."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession


def write_once(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Writes a table that must not exist yet."""
    df.write.format(kind).mode("errorifexists").save(path)


def json_sink(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "errorifexists").json(path)


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def canonical(manifest: dict) -> str:
    return json.dumps(manifest, sort_keys=True, ensure_ascii=False, indent=2)


def manifest_hash(manifest: dict) -> str:
    return hashlib.sha256(canonical(manifest).encode()).hexdigest()


def write_manifest(spark: SparkSession, path: str, kind: str, version: int, values: dict) -> dict:
    """Writes a manifest beside a table: to a temporary name first, then renamed."""
    manifest = {"format": kind, "format_version": version, **values}
    p, fs = _path(spark, path)
    tmp, _ = _path(spark, f"{path}.tmp")
    out = fs.create(tmp, True)
    out.write(bytearray(canonical(manifest).encode()))
    out.close()
    fs.delete(p, False)
    if not fs.rename(tmp, p):
        raise OSError(f"cannot publish {path}")
    return manifest


def read_manifest(spark: SparkSession, path: str, kind: str, version: int) -> dict | None:
    """The manifest, or None if there is none; another format or version is an error."""
    p, fs = _path(spark, path)
    if not fs.exists(p):
        return None
    manifest = json.loads("\n".join(r[0] for r in spark.read.text(path).collect()))
    if (manifest.get("format"), manifest.get("format_version")) != (kind, version):
        raise ValueError(f"{path} is not a {kind} manifest of version {version}")
    return manifest
