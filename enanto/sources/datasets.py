"""Dataset folders (manifest and samples table), raw tables, arrays by path, sweep records and their sinks."""

from __future__ import annotations

import io
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import map_arrow, ship

REQUIRED = ("schema_version", "domain", "id", "columns")
ROLES = {"group": "case_id", "time": "t", "size": "L", "handedness": "hand", "observable": ["O"]}
#: Defaults that change results; a manifest's ``analysis``, a file and explicit overrides are merged over them in that order.
DEFAULTS = {
    "knee": {"method": "segmented", "rho": 1.5, "bic_delta_min": 10.0, "knee_p_min": 0.35, "knee_strength_min": 0.5, "bootstrap_n": 200, "bootstrap_cov_max": 0.25, "edge_buffer_frac": 0.15, "slope_abs_max": 6.0},
    "scaling": {"method": "wls", "robust": True, "huber_delta": 1.5, "min_sizes": 4},
    "stability": {"b": 2.0, "marginal_eps": 0.1},
    "impedance": {"enabled": True, "tolerance": 0.1},
    "nulls": {"n": 200},
    "seed": 42,
}
_METHODS = {("knee", "method"): ("segmented", "log_curvature", "cpt"), ("scaling", "method"): ("wls", "theil_sen")}


class DatasetError(ValueError):
    """A dataset folder or configuration that can't be used."""


@dataclass
class Dataset:
    """A manifest and its samples, which stay lazy."""

    path: str
    spec: dict
    samples: DataFrame
    roles: dict = field(default_factory=dict)


def merged(*parts: dict | None) -> dict:
    """Deep merge, later parts win; unknown method names are refused."""
    out: dict = {}
    for p in parts:
        for k, v in (p or {}).items():
            out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    for (a, b), known in _METHODS.items():
        got = out.get(a, {}).get(b) if isinstance(out.get(a), dict) else None
        if got is not None and got not in known:
            raise DatasetError(f"{a}.{b} is {got!r}; known: {', '.join(known)}")
    return out


def configuration(spec: dict, file: dict | None = None, overrides: dict | None = None) -> dict:
    return merged(DEFAULTS, spec.get("analysis"), file, overrides)


def load_manifest(path: str) -> dict:
    import yaml

    at = os.path.join(path, "dataset.yaml")
    if not os.path.isfile(at):
        raise DatasetError(f"no manifest at {at}")
    with open(at) as f:
        spec = yaml.safe_load(f)
    if not isinstance(spec, dict):
        raise DatasetError("the manifest isn't a mapping")
    missing = [k for k in REQUIRED if k not in spec]
    if missing:
        raise DatasetError(f"the manifest lacks {', '.join(missing)}")
    return spec


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, or CSV with a header; of a folder its samples.parquet or samples.csv. Column types of CSV are inferred."""
    for name in ("samples.parquet", "samples.csv"):
        if os.path.isdir(path) and os.path.exists(os.path.join(path, name)):
            path = os.path.join(path, name)
            break
    if path.endswith((".csv", ".txt")):
        return spark.read.csv(path, header=True, inferSchema=True)
    if path.endswith(".parquet") or os.path.isdir(path):
        return spark.read.parquet(path)
    raise DatasetError(f"can't read {path}: parquet, csv, txt or a folder of them")


def by_role(samples: DataFrame, spec: dict, root: str | None = None) -> tuple[DataFrame, dict]:
    """Samples under canonical names (case_id, t, L, hand, O); the observable is the first listed column that exists.

    ``O_path`` counts as an observable whose arrays, below ``root``, are read and averaged.
    """
    roles = ROLES | (spec.get("columns") or {})
    missing = [roles[r] for r in ("group", "time", "size", "handedness") if roles[r] not in samples.columns]
    if missing:
        raise DatasetError(f"samples lack {', '.join(missing)}")
    listed = roles["observable"] if isinstance(roles["observable"], list) else [roles["observable"]]
    found = next((c for c in listed if c in samples.columns and c != "O_path"), None)
    if found is None and "O_path" not in samples.columns:
        raise DatasetError(f"samples lack an observable: {', '.join(listed)} or O_path")
    if found is None:
        if root is None:
            raise DatasetError("O_path needs the folder its arrays are in")
        samples, found = with_arrays(samples, root), "O_array"
    return samples.select(F.col(roles["group"]).cast("string").alias("case_id"), F.col(roles["time"]).alias("t"), F.col(roles["size"]).try_cast("double").alias("L"), F.col(roles["handedness"]).cast("string").alias("hand"), F.col(found).try_cast("double").alias("O")), roles


def with_arrays(samples: DataFrame, root: str) -> DataFrame:
    """Adds O_array: the mean of the .npy array at O_path, absolute or below ``root`` (null where there is no such file;
    NaN elements spread). Spark reads the files below ``root``, whatever the file system, and joins them by path."""
    spark = samples.sparkSession
    ship(spark)

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = [float(np.load(io.BytesIO(x), allow_pickle=False).mean()) for x in b["content"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["path"], pa.array(v, pa.float64())], names=["__path", "O_array"])

    bare = lambda c: F.regexp_replace(c, "^file:/+", "/")
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").option("recursiveFileLookup", "true").load(base).select("path", "content")
    found = map_arrow(files, means, "__path string, O_array double").select(bare(F.col("__path")).alias("__path"), "O_array")
    path = F.col("O_path")
    whole = F.when(path.rlike("^(/|[a-z0-9]+:)"), path).otherwise(F.concat(F.lit(base + "/"), path))
    wrong = F.when(path.isNotNull() & ~path.endswith(".npy"), F.raise_error(F.concat(F.lit("not an .npy file: "), path)).cast("string"))
    return samples.withColumn("__at", F.coalesce(wrong, bare(whole))).join(found, F.col("__at") == F.col("__path"), "left").drop("__at", "__path")


def load_dataset(spark: SparkSession, path: str) -> Dataset:
    spec = load_manifest(path)
    at = os.path.join(path, "samples.parquet")
    if not os.path.exists(at):
        raise DatasetError(f"no samples at {at}")
    samples, roles = by_role(spark.read.parquet(at), spec, path)
    return Dataset(path, spec, samples, roles)


def write_dataset(samples: DataFrame, path: str, domain: str, name: str, analysis: dict | None = None) -> None:
    """A dataset folder; samples come sorted within their files by case, time, size and hand."""
    import yaml

    need = {"case_id", "t", "L", "hand"} - set(samples.columns)
    if need or not {"O", "O_path"} & set(samples.columns):
        raise DatasetError(f"samples lack {', '.join(sorted(need)) or 'O or O_path'}")
    for sub in ("arrays", "assets"):
        os.makedirs(os.path.join(path, sub), exist_ok=True)
    samples.sortWithinPartitions("case_id", "t", "L", "hand").write.mode("overwrite").parquet(os.path.join(path, "samples.parquet"))
    spec = {"schema_version": 1, "domain": domain, "id": name, "columns": ROLES, "analysis": analysis or {}}
    with open(os.path.join(path, "dataset.yaml"), "w") as f:
        yaml.safe_dump(spec, f, sort_keys=False)


def read_sweep(spark: SparkSession, path: str) -> DataFrame:
    """Records of a JSON array (or one object per line)."""
    with open(path) as f:
        array = f.read(1) == "["
    return spark.read.json(path, multiLine=array)


def write_partitioned(df: DataFrame, path: str, by: list[str]) -> DataFrame:
    """Hive-partitioned Parquet, one file per partition and task; returns rows per partition as written."""
    df.repartition(*by).write.mode("overwrite").partitionBy(*by).parquet(path)
    return df.sparkSession.read.parquet(path).groupBy(*by).agg(F.count("*").alias("n_rows"))


def content_hash(path: str) -> str:
    """sha256 over the sorted relative paths and sha256 sums of a folder's files."""
    import hashlib

    names = sorted(os.path.relpath(os.path.join(r, f), path) for r, _, fs in os.walk(path) for f in fs)
    total = hashlib.sha256()
    for n in names:
        one = hashlib.sha256()
        with open(os.path.join(path, n), "rb") as f:
            for part in iter(lambda: f.read(1 << 20), b""):
                one.update(part)
        total.update(f"{n}\0{one.hexdigest()}\n".encode())
    return total.hexdigest()


def write_json(payload: dict, path: str) -> None:
    with open(path, "w") as f:
        json.dump(payload, f, sort_keys=True, indent=2, default=str)
