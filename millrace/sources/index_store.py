"""The index as versions of its partitions.

A version writes only the partitions (topic, sub-topic) that it touches, as
Parquet under `<table>/version=N`, and then one small manifest that names the
folder of every partition, old ones included. A reader follows one manifest, so
it sees a version whole or not at all, and may read on while the next is written.
Versions come from one writer at a time.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from urllib.parse import unquote

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

PARTITION = ["topic_id", "sub_topic_id"]
#: The columns that each table has, whatever wrote it.
TABLES = {
    "chunks": "chunk_id string, parent_id string, topic_id string, sub_topic_id string, source string, child_index int, content string, embedding array<float>",
    "parents": "parent_id string, topic_id string, sub_topic_id string, source string, parent_index int, content string, headers map<string,string>",
    "sidecars": "topic_id string, sub_topic_id string, rel_path string, origin_url string",
    "artifacts": "topic_id string, sub_topic_id string, artifact_name string, text string",
    "postings": "topic_id string, sub_topic_id string, token string, chunk_id string",
    "terms": "topic_id string, sub_topic_id string, token string, n long",
}
_MANIFEST = "table_name string, topic_id string, sub_topic_id string, folder string, writer string, batch long"


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, place = _folder(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(place)) if fs.exists(place) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, place = _folder(spark, path)
    fs.delete(place, True)


def conform(rows: DataFrame, name: str) -> DataFrame:
    """The columns of a table in their order and types; a missing one is an error."""
    kinds = dict(part.strip().split(" ", 1) for part in _columns(TABLES[name]))
    missing = [c for c in kinds if c not in rows.columns]
    if missing:
        raise ValueError(f"{name} lacks {', '.join(missing)}")
    return rows.select(*(F.col(c).cast(kind).alias(c) for c, kind in kinds.items()))


def _columns(schema: str) -> list[str]:
    """Parts of a schema string at commas outside of brackets."""
    out, depth = [""], 0
    for char in schema:
        depth += (char == "<") - (char == ">")
        if char == "," and not depth:
            out.append("")
        else:
            out[-1] += char
    return out


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a folder of Parquet was written to its end."""
    fs, mark = _folder(spark, f"{path}/_SUCCESS")
    return fs.exists(mark)


def versions(spark: SparkSession, path: str) -> list[int]:
    """Versions whose manifest is complete, oldest first."""
    done = [n for n in _names(spark, f"{path}/manifest") if complete(spark, f"{path}/manifest/{n}")]
    return sorted(int(n.removeprefix("version=")) for n in done)


def manifest(spark: SparkSession, path: str, version: int) -> list[Row]:
    """A row for each partition of each table: as many as there are folders of sources."""
    return spark.read.schema(_MANIFEST).parquet(f"{path}/manifest/version={version}").collect()


def read_table(spark: SparkSession, path: str, name: str, version: int | None = None, only: set[tuple[str, str]] | None = None) -> DataFrame:
    """A table of a version (the newest by default), or `only` its partitions named; empty where there is none."""
    if version is None:
        version = max(versions(spark, path), default=None)
    rows = [] if version is None else manifest(spark, path, version)
    folders = [f"{path}/{r.folder}" for r in rows if r.table_name == name and r.folder and (only is None or (r.topic_id, r.sub_topic_id) in only)]
    if not folders:
        return spark.createDataFrame([], TABLES[name])
    return conform(spark.read.schema(TABLES[name]).option("basePath", f"{path}/{name}").parquet(*folders), name)


def read_index(spark: SparkSession, path: str, version: int | None = None) -> tuple[DataFrame, DataFrame] | None:
    """(chunks, parents) of a version, by default the newest; None where there is none."""
    if version is None:
        version = max(versions(spark, path), default=None)
    return None if version is None else tuple(read_table(spark, path, name, version) for name in ("chunks", "parents"))


def version_of(spark: SparkSession, path: str, writer: str, batch: int) -> int | None:
    """The version that a writer made of its batch, newest first; None if there is none (or it was swept)."""
    for version in reversed(versions(spark, path)):
        if any(r.writer == writer and r.batch == batch for r in manifest(spark, path, version)):
            return version
    return None


def write_version(spark: SparkSession, path: str, tables: dict[str, tuple[DataFrame | Callable[[Callable[[str], DataFrame]], DataFrame], set[tuple[str, str]]]], writer: str = "", batch: int | None = None) -> int:
    """A new version; tables has rows by table name, and the partitions whose rows these are. All other partitions stay where they are.
    Rows may be a function: it is given what reads back this version's rows of an earlier table.

    A batch that its writer has written already changes nothing: its version is
    returned. A named partition without rows is gone from the new version.
    """
    done = versions(spark, path)
    old = manifest(spark, path, done[-1]) if done else []
    if batch is not None and (found := version_of(spark, path, writer, batch)) is not None:
        return found
    number = done[-1] + 1 if done else 0
    written = lambda name: conform(spark.read.schema(TABLES[name]).parquet(f"{path}/{name}/version={number}"), name)
    entries = [(r.table_name, r.topic_id, r.sub_topic_id, r.folder, r.writer, r.batch) for r in old if r.folder and not (r.table_name in tables and (r.topic_id, r.sub_topic_id) in tables[r.table_name][1])]
    for name, (rows, touched) in tables.items():
        if not touched:
            continue
        where = f"{name}/version={number}"
        whole = conform(rows(written) if callable(rows) else rows, name)
        # A partition is a file or, where it is large, several; postings are dealt out and sorted by token already.
        dealt = whole if name == "postings" else whole.hint("rebalance", *PARTITION)
        dealt.write.mode("overwrite").partitionBy(*PARTITION).parquet(f"{path}/{where}")
        for topic in _names(spark, f"{path}/{where}"):
            if topic.startswith("topic_id="):
                entries += [(name, *(unquote(part.split("=", 1)[1]) for part in (topic, sub)), f"{where}/{topic}/{sub}", writer, batch) for sub in _names(spark, f"{path}/{where}/{topic}")]
    entries.append(("", None, None, None, writer, batch))  # so that a batch without rows is known as well
    spark.createDataFrame(entries, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/version={number}")
    return number


@contextmanager
def pinned(spark: SparkSession, path: str) -> Iterator[int | None]:
    """The newest version, which `sweep` keeps as long as the block runs (and a lease allows)."""
    version = max(versions(spark, path), default=None)
    if version is None:
        yield None
        return
    mark = f"{path}/readers/version={version}-{uuid.uuid4().hex}"
    fs, place = _folder(spark, mark)
    fs.create(place).close()
    try:
        yield version
    finally:
        fs.delete(place, False)


def sweep(spark: SparkSession, path: str, keep: int = 2, lease_seconds: float = 86_400) -> list[int]:
    """Remove versions but the newest `keep` and those that readers hold; the versions that stay.

    A reader's mark older than lease_seconds no longer counts: its job is
    taken for dead. Folders go that no manifest that stays names.
    """
    done = versions(spark, path)
    fs, readers = _folder(spark, f"{path}/readers")
    held = {int(f.getPath().getName().removeprefix("version=").split("-")[0]) for f in (fs.listStatus(readers) if fs.exists(readers) else []) if f.getModificationTime() / 1000 > time.time() - lease_seconds}
    stay = [v for v in done if v in held or v in done[-keep:]]
    used = {r.folder for v in stay for r in manifest(spark, path, v) if r.folder}
    for version in done:
        if version not in stay:
            remove(spark, f"{path}/manifest/version={version}")
    for name in TABLES:
        for version in (n for n in _names(spark, f"{path}/{name}") if done and int(n.removeprefix("version=")) <= done[-1]):
            where, left = f"{name}/{version}", 0
            for topic in (t for t in _names(spark, f"{path}/{where}") if t.startswith("topic_id=")):
                for sub in _names(spark, f"{path}/{where}/{topic}"):
                    if f"{where}/{topic}/{sub}" in used:
                        left += 1
                    else:
                        remove(spark, f"{path}/{where}/{topic}/{sub}")
            if not left and int(version.removeprefix("version=")) not in stay:
                remove(spark, f"{path}/{where}")
    return stay
