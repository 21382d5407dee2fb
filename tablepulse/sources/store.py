"""Objects by location: local paths and file:, http(s):, and what Hadoop's file systems know (s3 is read as s3a)."""

from __future__ import annotations

import os
import urllib.request
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


HADOOP_SCHEMES = ("s3", "s3a", "s3n", "hdfs", "viewfs", "abfs", "abfss", "gs")


def scheme_of(location: str) -> str:
    return location.split("://", 1)[0].lower() if "://" in location else "file" if location.startswith("file:") else ""


def local_path(location: str) -> str:
    return location.removeprefix("file://").removeprefix("file:") if location.startswith("file:") else location


def fetch_bytes(location: str, spark: SparkSession | None = None, token: str | None = None, timeout: float = 30) -> bytes:
    """The whole object. Remote schemes other than http(s) need a session."""
    kind = scheme_of(location)
    if kind in ("", "file"):
        return Path(local_path(location)).read_bytes()
    if kind in ("http", "https"):
        headers = {"Authorization": f"Bearer {token}"} if token else {}
        with urllib.request.urlopen(urllib.request.Request(location, headers=headers), timeout=timeout) as r:
            return r.read()
    if kind not in HADOOP_SCHEMES:
        raise ValueError(f"no reader for {location}")
    if spark is None:
        raise ValueError(f"{location} is read through a Spark session")
    rows = spark.read.format("binaryFile").load(hadoop_location(location)).select("content").collect()  # one object
    return bytes(rows[0][0])


def hadoop_location(location: str) -> str:
    return "s3a://" + location.split("://", 1)[1] if scheme_of(location) in ("s3", "s3n") else location


def hadoop_files(spark: SparkSession, locations: list[str]) -> tuple[dict[str, str], dict[str, str]]:
    """The full names, as Hadoop has them, of locations that exist; and what is wrong with the others."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    if any(scheme_of(x) in ("s3", "s3a", "s3n") for x in locations):
        for k, v in s3_settings(os.environ.get("AWS_ENDPOINT_URL")).items():
            conf.setIfUnset(k, v)

    def look(location: str) -> tuple[str, str | None, str | None]:
        path = jvm.org.apache.hadoop.fs.Path(hadoop_location(location))
        try:
            system = path.getFileSystem(conf)
            return (location, system.makeQualified(path).toString(), None) if system.exists(path) else (location, None, "not found")
        except Py4JJavaError as e:
            return location, None, str(e.java_exception)

    with ThreadPoolExecutor(16) as pool:
        found = list(pool.map(look, locations))
    return {k: v for k, v, _ in found if v}, {k: e for k, _, e in found if e}


def s3_settings(endpoint: str | None = None) -> dict[str, str]:
    """Hadoop settings for path-style access with the standard chain of credentials."""
    out = {"fs.s3a.path.style.access": "true"}
    return out | ({"fs.s3a.endpoint": endpoint} if endpoint else {})
