"""python -m enanto.cli validate|prepare|run|audit|report|diagnose|schema|calibrate PATH ...: dataset folders from the command line."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import functions as F

from .functions.aggregates import median
from .operators import curve, evaluation, knees, pairing
from .session import build_session, drop_scratch
from .sources import datasets


def _numbered(samples):
    """With the columns pairing asks for; no key has two readings of a hand (see :func:`run`), so any number does."""
    return samples.withColumn("sample_id", F.lit(0).cast("long")).withColumn("load_id", F.lit(None).cast("long"))


def validate(spark, path: str, allow_missing: bool = False) -> dict:
    """Issues with level and code, and whether the dataset is valid; incomplete pairing is an error unless allowed."""
    try:
        d = datasets.load_dataset(spark, path)
    except datasets.DatasetError as e:
        return {"valid": False, "completeness": 0.0, "issues": [{"level": "error", "code": "io_error", "message": str(e)}]}
    keys = d.samples.groupBy("case_id", "t", "L").agg(F.count_distinct("hand").alias("h")).agg(F.avg((F.col("h") == 2).cast("double")).alias("c"))
    n = d.samples.agg(F.count_if(~F.col("hand").isin("L", "R")).alias("hand"), F.count_if(F.col("L").isNull() | F.isnan("L")).alias("size")).first()
    complete = keys.first()["c"] or 0.0
    soft = "warning" if allow_missing else "error"
    issues = []
    if n["hand"]:
        issues.append({"level": "error", "code": "invalid_hand_values", "message": f"{n['hand']} rows with a hand other than L or R"})
    if n["size"]:
        issues.append({"level": soft, "code": "invalid_size_values", "message": f"{n['size']} rows without a finite size"})
    if complete < 0.99:
        issues.append({"level": soft, "code": "pairing_completeness", "message": f"completeness {complete:.3f} is below 0.990"})
    return {"valid": not any(i["level"] == "error" for i in issues), "completeness": complete, "issues": issues}


def run(spark, path: str, out: str, overrides: dict | None = None) -> dict:
    """Pair, build the curve of the whole dataset, find its knee and scaling; writes results and metadata."""
    d = datasets.load_dataset(spark, path)
    config = datasets.configuration(d.spec, None, overrides)
    twice = pairing.duplicate_keys(_numbered(d.samples)).limit(3).collect()
    if twice:
        raise datasets.DatasetError("more than one reading of a hand: " + ", ".join(f"{r.case_id} {r.t} {r.L} {r.hand}" for r in twice))
    pairs = pairing.pair_table(_numbered(d.samples)).withColumn("series", F.lit(d.spec["id"]))
    c = curve.eta_by_size(pairs, ["series"])
    points = curve.log_points(c, "series")
    k = config["knee"]
    options = {n: k[n] for n in ("method", "bic_delta_min", "knee_strength_min", "knee_p_min", "bootstrap_n", "bootstrap_cov_max", "edge_buffer_frac", "slope_abs_max", "rho")}
    result = knees.diagnose(points, "series", options, config["scaling"]["min_sizes"]).withColumnRenamed("series", "__s")
    table = c.join(result, F.col("series") == F.col("__s")).drop("__s")
    table.write.mode("overwrite").parquet(os.path.join(out, "results.parquet"))
    head = spark.read.parquet(os.path.join(out, "results.parquet")).orderBy("L").first()
    meta = {"dataset": d.spec["id"], "domain": d.spec["domain"], "config": config, "has_knee": head and head["has_knee"], "gamma": head and head["gamma"]}
    datasets.write_json(meta, os.path.join(out, "metadata.json"))
    return meta


def diagnose(spark, path: str) -> dict:
    """What a dataset has: rows, cases, sizes, instants, hands, keys with both hands, and how many sizes a case has at least."""
    d = datasets.load_dataset(spark, path)
    x = d.samples
    n = x.agg(F.count("*").alias("n_rows"), F.count_distinct("case_id").alias("n_cases"), F.count_distinct("L").alias("n_sizes"), F.count_distinct("t").alias("n_times"), F.count_if(F.col("O").isNull() | F.isnan("O")).alias("n_no_observable")).first()
    keys = pairing.completeness(_numbered(x)).agg(F.sum("n_keys").alias("n_keys"), F.sum("n_complete").alias("n_complete")).first()
    sizes = x.groupBy("case_id").agg(F.count_distinct("L").alias("k")).agg(F.min("k").alias("fewest_sizes")).first()
    return {"dataset": d.spec["id"], "domain": d.spec["domain"], **n.asDict(), **keys.asDict(), **sizes.asDict()}


def calibrate(spark, table: str, out: str) -> dict:
    """The thresholds that separate the runs of a results table best, written as JSON."""
    best = evaluation.best_thresholds(evaluation.runs(datasets.read_table(spark, table))).collect()
    found = best[0].asDict() if best else {}
    datasets.write_json(found, out)
    return found


def schema(spark, path: str) -> dict:
    """Canonical columns of a dataset with their types and the columns they come from."""
    d = datasets.load_dataset(spark, path)
    return {"columns": {f.name: f.dataType.simpleString() for f in d.samples.schema}, "roles": d.roles}


def audit(spark, out: str) -> dict:
    """Decision and reasons of a finished run."""
    r = spark.read.parquet(os.path.join(out, "results.parquet"))
    head, eta = r.orderBy("L").first(), r.agg(median(F.col("eta")).alias("e")).first()["e"]
    if head is None:
        return {"decision": "reject", "reasons": ["empty"]}
    why = [x for x in (head["reasons"] or "").split(";") if x]
    if head["gamma"] is None:
        why.append("no_scaling")
    return {"decision": "accept" if head["has_knee"] and not why else "reject", "reasons": why, "gamma": head["gamma"], "eta_median": eta}


def report(spark, out: str) -> str:
    """An HTML page of a finished run: its decision, its curve as an inline drawing, and its rows (one per size)."""
    import html
    import math

    rows = [r.asDict() for r in spark.read.parquet(os.path.join(out, "results.parquet")).orderBy("L").collect()]
    xy = [(math.log(r["L"]), math.log(max(r["eta"], 1e-12))) for r in rows if r["L"] > 0 and r["eta"] is not None]
    drawing = ""
    if xy:
        (x0, x1), (y0, y1) = ((min(v), max(v)) for v in zip(*xy))
        at = [(20 + 560 * (x - x0) / max(x1 - x0, 1e-12), 280 - 260 * (y - y0) / max(y1 - y0, 1e-12)) for x, y in xy]
        line = " ".join(f"{x:.1f},{y:.1f}" for x, y in at)
        dots = "".join(f'<circle cx="{x:.1f}" cy="{y:.1f}" r="3"/>' for x, y in at)
        drawing = f'<svg width="600" height="300" role="img" aria-label="ln eta against ln L"><polyline points="{line}" fill="none" stroke="black"/>{dots}</svg>'
    names = list(rows[0]) if rows else []
    cells = "".join("<tr>" + "".join(f"<td>{html.escape(str(r[n]))}</td>" for n in names) + "</tr>" for r in rows)
    head = "".join(f"<th>{html.escape(n)}</th>" for n in names)
    page = f"<!doctype html><title>Run</title><p>{html.escape(json.dumps(audit(spark, out), default=str))}</p>{drawing}<table><tr>{head}</tr>{cells}</table>"
    with open(os.path.join(out, "report.html"), "w") as f:
        f.write(page)
    return page


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="enanto")
    sub = p.add_subparsers(dest="command", required=True)
    v = sub.add_parser("validate")
    v.add_argument("path")
    v.add_argument("--allow-missing", action="store_true")
    r = sub.add_parser("run")
    r.add_argument("path")
    r.add_argument("--out", required=True)
    a = sub.add_parser("audit")
    a.add_argument("out")
    h = sub.add_parser("report")
    h.add_argument("out")
    for name in ("diagnose", "schema"):
        sub.add_parser(name).add_argument("path")
    k = sub.add_parser("calibrate")
    k.add_argument("table")
    k.add_argument("--out", required=True)
    c = sub.add_parser("prepare")
    c.add_argument("table")
    c.add_argument("--out", required=True)
    c.add_argument("--domain", default="custom")
    ns = p.parse_args(argv)
    spark = build_session()
    try:
        if ns.command == "validate":
            report = validate(spark, ns.path, ns.allow_missing)
            print(json.dumps(report))
            return 0 if report["valid"] else 1
        if ns.command == "prepare":
            datasets.write_dataset(datasets.read_table(spark, ns.table), ns.out, ns.domain, os.path.basename(ns.out.rstrip("/")))
        elif ns.command == "run":
            print(json.dumps(run(spark, ns.path, ns.out), default=str))
        elif ns.command == "report":
            report(spark, ns.out)
        elif ns.command in ("diagnose", "schema"):
            print(json.dumps({"diagnose": diagnose, "schema": schema}[ns.command](spark, ns.path), default=str))
        elif ns.command == "calibrate":
            print(json.dumps(calibrate(spark, ns.table, ns.out), default=str))
        else:
            print(json.dumps(audit(spark, ns.out), default=str))
        return 0
    except datasets.DatasetError as e:
        print(e, file=sys.stderr)
        return 2
    finally:
        drop_scratch(spark)


if __name__ == "__main__":
    sys.exit(main())
