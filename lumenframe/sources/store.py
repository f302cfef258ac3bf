"""The store: a folder of Parquet tables, one for each variable, with metadata beside the data.

A variable lies in <folder>/<name>; <folder>/_meta.json holds its metadata coordinates, which reads add as
literal columns. Metadata updates rewrite that small file only; data files stay as they are. All access goes through
Spark's readers, writers and file system layer, so any store that Spark reaches will do.
"""

from __future__ import annotations

import json
import re
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    p, fs = _fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def _read_text(spark: SparkSession, path: str) -> str | None:
    p, fs = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def read_meta(spark: SparkSession, folder: str) -> dict:
    text = _read_text(spark, f"{folder}/_meta.json")
    return json.loads(text) if text else {}


def update_meta(spark: SparkSession, folder: str, meta: dict) -> None:
    """Set metadata coordinates of every variable in a folder; data files are not touched."""
    _write_text(spark, f"{folder}/_meta.json", json.dumps(read_meta(spark, folder) | meta))


def meta_from_path(folder: str, levels: dict[str, int]) -> dict:
    """Metadata from a folder's own path: levels maps names to places, -1 the folder above."""
    parts = [p for p in folder.rstrip("/").split("/") if p]
    return {name: parts[place - 1] if place < 0 else parts[place] for name, place in levels.items()}


def save(df: DataFrame, folder: str, name: str, meta: dict | None = None, overwrite: bool = False, order: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """Write a variable and return it as read back, which cuts its lineage.

    The table is written beside its place and then moved there, so a variable may be overwritten while it is read. What
    stood there is moved aside first and goes last; open_variable takes it back if a driver was lost in between.
    order clusters the rows by range, for reads along it.
    """
    spark = df.sparkSession
    target, fs = _fs(spark, f"{folder}/{name}")
    if fs.exists(target) and not overwrite:
        raise FileExistsError(f"{folder}/{name}")
    if order:
        df = (df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)).sortWithinPartitions(*order)
    elif parts:
        df = df.repartition(parts)
    fresh = f"{folder}/_tmp-{uuid.uuid4().hex}"
    df.write.parquet(fresh)
    aside = _fs(spark, f"{folder}/_old-{name}")[0]
    if fs.exists(target):
        fs.delete(aside, True)
        fs.rename(target, aside)
    fs.rename(_fs(spark, fresh)[0], target)
    fs.delete(aside, True)
    if meta:
        update_meta(spark, folder, meta)
    return open_variable(spark, folder, name)


def open_variable(spark: SparkSession, folder: str, name: str) -> DataFrame:
    target, fs = _fs(spark, f"{folder}/{name}")
    aside = _fs(spark, f"{folder}/_old-{name}")[0]
    if not fs.exists(target) and fs.exists(aside):
        fs.rename(aside, target)
    df = spark.read.parquet(f"{folder}/{name}")
    return df.withColumns({k: F.lit(v) for k, v in read_meta(spark, folder).items()})


def variables(spark: SparkSession, folder: str) -> list[str]:
    p, fs = _fs(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory() and not s.getPath().getName().startswith(("_", ".")))


def open_all(spark: SparkSession, folder: str, post_process=None) -> dict[str, DataFrame]:
    """Every variable of a folder; post_process(variables, folder) may change them."""
    found = {n: open_variable(spark, folder, n) for n in variables(spark, folder)}
    return post_process(found, folder) if post_process else found


def find_folders(spark: SparkSession, root: str, pattern: str = r"store$", sub_dirs: list[str] | None = None, exclude: bool = True) -> list[str]:
    """Folders below root whose names match; those that match sub_dirs go (exclude) or alone stay."""
    out, todo = [], [root]
    while todo:
        here = todo.pop()
        p, fs = _fs(spark, here)
        for s in fs.listStatus(p):
            if not s.isDirectory():
                continue
            path = s.getPath().toString()
            if re.search(pattern, s.getPath().getName()):
                hit = any(d in path for d in sub_dirs or [])
                if not sub_dirs or hit != exclude:
                    out.append(path)
            else:
                todo.append(path)
    return sorted(out)


def open_many(spark: SparkSession, root: str, index: dict[str, int], name: str, pattern: str = r"store$", **how) -> DataFrame:
    """One variable of all folders found, with the index columns their paths give."""
    parts = []
    for folder in find_folders(spark, root, pattern, **how):
        keys = meta_from_path(folder, index)
        df = open_variable(spark, folder, name)
        parts.append(df.withColumns({k: F.lit(v) for k, v in keys.items()}))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def optimal_rows(bytes_per_row: int, target_mb: int = 256) -> int:
    """Rows of a partition of about target_mb."""
    return max(1, target_mb * (1 << 20) // max(1, bytes_per_row))


def factors(n: int) -> list[int]:
    return [k for k in range(1, n + 1) if n % k == 0] if n < 10_000 else sorted({d for k in range(1, int(n**0.5) + 1) if n % k == 0 for d in (k, n // k)})


def chunk_plan(sizes: dict[str, int], item_bytes: int, along: str, target_mb: int = 256) -> tuple[int, int]:
    """(labels of `along` in a computed block, in a stored one): the first from the target size, the second the nearest divisor below it."""
    rest = item_bytes
    for d, n in sizes.items():
        rest *= n if d != along else 1
    rows = min(sizes[along], optimal_rows(rest, target_mb))
    return rows, max(f for f in factors(sizes[along]) if f <= rows)


def co_partition(a: DataFrame, b: DataFrame, keys: list[str], parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Both tables dealt by the same keys into as many partitions, so that joins and groups by them need no further shuffle."""
    n = parts or int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return a.repartition(n, *keys), b.repartition(n, *keys)


def export_long(df: DataFrame, path: str, form: str = "csv") -> None:
    """The cells as CSV or Parquet."""
    df.write.mode("overwrite").option("header", True).format(form).save(path)
