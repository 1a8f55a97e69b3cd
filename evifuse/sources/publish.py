"""Publication: tables of one generation, a manifest of their files' digests, and a pointer that is switched last.

Readers follow the pointer, so they see a whole generation or the one before it. A publication that fails takes away what it has written, the
pointer's next version included. The lock and the pointer are small
files on the driver's side of the store; tables are written by the executors.
"""

from __future__ import annotations

import contextlib
import json
import os
import re
import shutil
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


#: What publication itself tells, and the layers that a payload lists.
RESERVED, MOST_LAYERS = {"generation", "layers", "rows"}, 64


@contextlib.contextmanager
def locked(folder: str) -> Iterator[None]:
    """Fails at once if another publisher is at work; only the owner removes the lock."""
    path, token = os.path.join(folder, ".publishing"), uuid.uuid4().hex
    os.makedirs(folder, exist_ok=True)
    with open(path, "x") as lock:
        lock.write(token)
    try:
        yield
    finally:
        with open(path) as lock:
            own = lock.read() == token
        if own:
            os.remove(path)


def digests(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(folder)
    return files.select(F.regexp_replace("path", r"^.*/generation-[0-9a-f]+/", "").alias("file"), F.sha2("content", 256).alias("sha256"), "length")


def publish(folder: str, layers: dict[str, DataFrame], metadata: dict, overwrite: bool = False) -> str:
    """Write the layers as a new generation and point to it; returns its name. Layers' names are file names, the metadata's are not ours."""
    reserved = RESERVED & metadata.keys()
    if reserved:
        raise ValueError(f"reserved metadata: {sorted(reserved)}")
    odd = sorted(name for name in layers if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_-]*", name))
    if odd or not layers:
        raise ValueError(f"layers without a portable name: {odd}")
    json.dumps(metadata, allow_nan=False)  # before anything is written
    with locked(folder):
        pointer = os.path.join(folder, "CURRENT")
        if os.path.exists(pointer) and not overwrite:
            raise FileExistsError(pointer)
        name = f"generation-{uuid.uuid4().hex}"
        try:
            rows = {}
            for layer, df in layers.items():
                seen = Observation()
                df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(os.path.join(folder, name, layer))
                rows[layer] = seen.get["rows"]
            spark = next(iter(layers.values())).sparkSession
            digests(spark, os.path.join(folder, name)).write.parquet(os.path.join(folder, name + ".manifest"))
            with open(os.path.join(folder, name + ".json"), "w") as out:
                json.dump(metadata | {"generation": name, "layers": sorted(layers), "rows": rows}, out, sort_keys=True, allow_nan=False)
            with open(pointer + ".new", "w") as out:
                out.write(name)
            os.replace(pointer + ".new", pointer)
        except BaseException:
            for left in (name, name + ".manifest"):
                shutil.rmtree(os.path.join(folder, left), ignore_errors=True)
            for left in (name + ".json", "CURRENT.new"):
                with contextlib.suppress(FileNotFoundError):
                    os.remove(os.path.join(folder, left))
            raise
    return name


def current(folder: str) -> dict:
    """The metadata of the generation that the pointer names, with its name, its layers and their rows."""
    with open(os.path.join(folder, "CURRENT")) as pointer:
        name = pointer.read()
    with open(os.path.join(folder, name + ".json")) as told:
        return json.load(told)


def layer(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A layer of the current generation, the same one however often it is read, even when another is published meanwhile."""
    told = current(folder)
    if name not in told["layers"]:
        raise KeyError(name)
    return spark.read.parquet(os.path.join(folder, told["generation"], name))


def payload(spark: SparkSession, folder: str, layers: int = MOST_LAYERS) -> dict:
    """What a viewer needs to know first: the generation, its metadata, and each layer's columns and rows; so many layers at most, the rest only counted."""
    told = current(folder)
    shown = told["layers"][:layers]
    columns = {name: {f.name: f.dataType.simpleString() for f in spark.read.parquet(os.path.join(folder, told["generation"], name)).schema} for name in shown}
    return {k: v for k, v in told.items() if k not in RESERVED} | {"generation": told["generation"], "layers": [{"name": n, "rows": told["rows"][n],
        "columns": columns[n]} for n in shown], "omitted": len(told["layers"]) - len(shown)}


def verify(spark: SparkSession, folder: str) -> DataFrame:
    """Files of the current generation that are missing, added or changed since publication."""
    with open(os.path.join(folder, "CURRENT")) as pointer:
        name = pointer.read()
    told = spark.read.parquet(os.path.join(folder, name + ".manifest")).select("file", F.col("sha256").alias("told"))
    found = digests(spark, os.path.join(folder, name)).select("file", F.col("sha256").alias("found"))
    fault = F.when(F.col("found").isNull(), "missing").when(F.col("told").isNull(), "added").when(F.col("found") != F.col("told"), "changed")
    return told.join(found, "file", "full_outer").select("file", fault.alias("fault")).where("fault IS NOT NULL")
