"""Several tables loaded as one: readers see all of a load or nothing of it.

A load writes its tables to a folder of its own. When all are there it publishes
a manifest, a small file under the next number, whose name appears at once and
whole. Readers take the manifest with the highest number. So a load that dies
leaves files that no manifest names, and readers go on with the load before.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tallyforge.scratch import path_of


class LoadConflict(RuntimeError):
    """Other loads published meanwhile, again and again."""


def _numbers(spark: SparkSession, root: str) -> list[int]:
    path, store = path_of(spark, f"{root}/manifests")
    names = [s.getPath().getName() for s in store.listStatus(path)] if store.exists(path) else []
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit())


def manifest(spark: SparkSession, root: str, number: int | None = None) -> dict | None:
    """The manifest of that number, or the last one; null before the first load."""
    known = _numbers(spark, root)
    number = number if number is not None else max(known, default=None)
    if number is None:
        return None
    if number not in known:
        raise FileNotFoundError(f"no load {number} under {root}")
    return json.loads(spark.read.text(f"{root}/manifests/{number:012d}.json", wholetext=True).first()[0])  # one small file


def load(spark: SparkSession, root: str, tables: dict[str, DataFrame], attempts: int = 20) -> dict:
    """Writes ``tables`` as the next load under ``root``; the manifest that says where they are and how many rows each has.

    Tables that an earlier load had and this one has not are gone from the next
    readers' view: a load is the whole set.
    """
    own = f"{root}/loads/{uuid.uuid4().hex}"
    listed = {}
    for name, df in tables.items():
        told = Observation()
        df.observe(told, F.count(F.lit(1)).alias("n")).write.parquet(f"{own}/{name}")
        listed[name] = {"path": f"{own}/{name}", "rows": told.get["n"], "schema": df.schema.json()}
    for _ in range(attempts):
        number = max(_numbers(spark, root), default=0) + 1
        said = {"number": number, "tables": listed}
        draft, store = path_of(spark, f"{own}/manifest-{number}.json")
        out = store.create(draft, True)
        out.write(bytearray(json.dumps(said, sort_keys=True).encode()))
        out.close()
        final, _ = path_of(spark, f"{root}/manifests/{number:012d}.json")
        store.mkdirs(final.getParent())
        if not store.exists(final) and store.rename(draft, final):
            return said
    raise LoadConflict(f"{root}: no number was free in {attempts} attempts; the tables are in {own}")


def read(spark: SparkSession, root: str, number: int | None = None) -> dict[str, DataFrame]:
    """The tables of one load, the last one unless a number is named; none before the first."""
    from pyspark.sql.types import StructType

    found = manifest(spark, root, number)
    return {n: spark.read.schema(StructType.fromJson(json.loads(t["schema"]))).parquet(t["path"]) for n, t in found["tables"].items()} if found else {}


def forget(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Removes all but the last ``keep`` loads, and what loads that died have left; the folders that went. Run it while no load is under way."""
    numbers = _numbers(spark, root)
    named = [manifest(spark, root, n) for n in numbers[-keep:]] if keep else []
    wanted = {t["path"].rsplit("/", 1)[0].rsplit("/", 1)[1] for m in named for t in m["tables"].values()}
    for n in numbers[: -keep or None]:
        path, store = path_of(spark, f"{root}/manifests/{n:012d}.json")
        store.delete(path, False)
    path, store = path_of(spark, f"{root}/loads")
    gone = [s.getPath() for s in store.listStatus(path) if s.getPath().getName() not in wanted] if store.exists(path) else []
    for p in gone:
        store.delete(p, True)
    return [p.getName() for p in gone]
