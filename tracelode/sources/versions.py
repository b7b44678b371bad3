"""Versioned tables on plain Parquet: one folder for each version, a commit file that only one writer can create."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


class VersionConflict(RuntimeError):
    """Another writer published the version first."""


def _file_system(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def latest_version(spark: SparkSession, root: str) -> int:
    """The highest published version; 0 where there is none."""
    files, folder = _file_system(spark, f"{root}/_commits")
    if not files.exists(folder):
        return 0
    return max((int(s.getPath().getName().removesuffix(".json")) for s in files.listStatus(folder) if s.getPath().getName().endswith(".json")), default=0)


def publish(tables: dict[str, DataFrame], root: str, expected: int) -> int:
    """Write ``tables`` as version ``expected`` + 1. The rows lie in a folder of their own before the commit file makes them the version; who comes second gets VersionConflict and no version."""
    spark = next(iter(tables.values())).sparkSession
    if latest_version(spark, root) != expected:
        raise VersionConflict(f"expected version {expected}")
    version, token = expected + 1, spark.sparkContext._jvm.java.util.UUID.randomUUID().toString()
    for name, table in tables.items():
        table.write.parquet(f"{root}/data/{version}-{token}/{name}")
    files, target = _file_system(spark, f"{root}/_commits/{version}.json")
    try:
        out = files.create(target, False)  # fails where the file exists
    except Exception as error:
        raise VersionConflict(f"version {version} is taken") from error
    out.write(bytearray(json.dumps({"version": version, "data": f"{version}-{token}", "tables": sorted(tables)}).encode()))
    out.close()
    return version


def read_version(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    """A table of a version, by default the latest."""
    version = version or latest_version(spark, root)
    commit = json.loads("".join(r["value"] for r in spark.read.text(f"{root}/_commits/{version}.json").collect()))
    return spark.read.parquet(f"{root}/data/{commit['data']}/{name}")


def copy_version(spark: SparkSession, root: str, target: str, version: int | None = None) -> int:
    """Copy one version, by default the latest, as the first version of ``target``: later versions of ``root`` do not touch it."""
    version = version or latest_version(spark, root)
    commit = json.loads("".join(r["value"] for r in spark.read.text(f"{root}/_commits/{version}.json").collect()))
    return publish({name: spark.read.parquet(f"{root}/data/{commit['data']}/{name}") for name in commit["tables"]}, target, 0)
