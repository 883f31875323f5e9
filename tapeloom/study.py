"""A study: tables to a folder, their hashes, and a report from them.

All tables are Spark jobs; the driver handles small aggregates, JSON and Markdown only. A folder is used
once: it must be new, its state goes from RUNNING to COMPLETE, and a report is made only of a COMPLETE
study whose tables, settings and split still match their hashes and whose access log begins as it was sealed.
The log is only ever added to: what was written when the study was completed must stay.
"""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tapeloom import plans

#: Name, query and whether the table is small enough for CSV and the report.
TABLES = (
    ("task_manifest", "task_manifest", False), ("worlds", "worlds", False), ("world_outcomes", "world_outcomes", False), ("markouts", "markouts", False), ("quality_intervals", "quality_intervals", False),
    ("markout_summary", "markout_summary", True), ("primary_pair", "primary_pair", True), ("secondary_pairs", "secondary_pairs", True), ("latency_table", "latency_table", True),
    ("policy_distribution", "policy_distribution", True), ("epsilon_sensitivity", "epsilon_sensitivity", True), ("support_gate", "support_gate", True), ("select_theta", "select_theta", True), ("guardrails", "guardrails", True),
)
UNDEFINED = "not estimable"
LOG, INPUTS = "access.jsonl", ("config.json", "split.json")


def _file_digest(path: Path) -> bytes:
    with path.open("rb") as f:
        return hashlib.file_digest(f, "sha256").digest()


def _digest(path: Path) -> str:
    """SHA-256 over a table's part files, in order of name; files are read in blocks."""
    h = hashlib.sha256()
    for p in sorted(path.glob("part-*")):
        h.update(_file_digest(p))
    return h.hexdigest()


def log_access(out: str, what: str, why: str) -> None:
    """A line of the access log: what of a study was read, and why. Only ever added."""
    with (Path(out) / LOG).open("a") as f:
        n = sum(1 for _ in (Path(out) / LOG).open())
        f.write(json.dumps({"n": n, "what": what, "why": why}, sort_keys=True) + "\n")


def _log_seal(folder: Path, size: int | None = None) -> dict:
    """Length and SHA-256 of the log, or of its first ``size`` bytes."""
    text = (folder / LOG).read_bytes() if (folder / LOG).exists() else b""
    size = len(text) if size is None else size
    if not 0 < size <= len(text):
        raise ValueError("the access log is empty or was cut short")
    return {"bytes": size, "sha256": hashlib.sha256(text[:size]).hexdigest()}


def sealed_inputs(folder: Path) -> dict[str, str]:
    return {n: _file_digest(folder / n).hex() for n in INPUTS if (folder / n).exists()}


def _state(out: Path, state: str, detail: str = "") -> None:
    (out / "status.json").write_text(json.dumps({"state": state, "detail": detail}, sort_keys=True))


def run_study(spark: SparkSession, sf_dir: str, out: str, tables=TABLES, split: dict[str, list[str]] | None = None) -> dict[str, str]:
    """Writes each table as Parquet, small ones as CSV too, and freezes their hashes, those of the settings and of the
    ``split`` of sessions if one is given, and the access log so far."""
    folder = Path(out)
    folder.mkdir(parents=True, exist_ok=False)
    _state(folder, "RUNNING")
    (folder / "config.json").write_text(json.dumps({"tables": [list(t) for t in tables], "input": sf_dir}, sort_keys=True))
    if split is not None:
        twice = {s for k, v in split.items() for s in v if any(s in w for j, w in split.items() if j != k)}
        if twice:
            raise ValueError(f"sessions in several parts of the split: {sorted(twice)}")
        (folder / "split.json").write_text(json.dumps(split, sort_keys=True))
    inputs = sealed_inputs(folder)
    log_access(out, "study", "started")
    try:
        known, hashes = plans.queries(), {}
        for name, query, small in tables:
            log_access(out, name, f"query {query}")
            df: DataFrame = known[query](spark, sf_dir)
            df.write.mode("errorifexists").parquet(f"file://{folder.resolve()}/{name}.parquet")
            hashes[f"{name}.parquet"] = _digest(folder / f"{name}.parquet")
            if small:
                spark.read.parquet(f"file://{folder.resolve()}/{name}.parquet").toPandas().sort_index(axis=1).to_csv(folder / f"{name}.csv", index=False)
        (folder / "freeze.json").write_text(json.dumps(hashes, sort_keys=True))
        if sealed_inputs(folder) != inputs:
            raise ValueError("settings or split changed while the study ran")
        (folder / "seal.json").write_text(json.dumps({"inputs": inputs, "log": _log_seal(folder)}, sort_keys=True))
        _state(folder, "COMPLETE")
        return hashes
    except Exception as e:
        _state(folder, "FAILED", str(e)[:500])
        raise


def require_complete(out: str) -> dict[str, str]:
    """The frozen hashes of a complete study; an error if its state, a table, its settings, its split or the sealed
    beginning of its access log differs."""
    folder = Path(out)
    if json.loads((folder / "status.json").read_text())["state"] != "COMPLETE":
        raise ValueError("the study is not complete")
    frozen = json.loads((folder / "freeze.json").read_text())
    changed = [n for n, h in frozen.items() if _digest(folder / n) != h]
    if changed:
        raise ValueError(f"tables differ from their frozen hashes: {changed}")
    seal = json.loads((folder / "seal.json").read_text())
    if sealed_inputs(folder) != seal["inputs"]:
        raise ValueError("settings or split differ from their frozen hashes")
    if _log_seal(folder, seal["log"]["bytes"]) != seal["log"]:
        raise ValueError("the access log does not begin as it was sealed")
    return frozen


def _cell(v: str) -> str:
    return UNDEFINED if v == "" else v.replace("|", "\\|").replace("\r", " ").replace("\n", " ")


def write_report(out: str) -> Path:
    """report.md with a section for each small table. What is undefined reads so, never 0."""
    import csv

    folder, frozen = Path(out), require_complete(out)
    log_access(out, "report", "written")
    lines = ["# Study", "", f"{len(frozen)} tables, frozen.", ""]
    for path in sorted(folder.glob("*.csv")):
        with path.open() as f:
            rows = list(csv.reader(f))
        lines += [f"## {path.stem}", ""]
        if len(rows) < 2:
            lines += ["No rows.", ""]
            continue
        lines += ["| " + " | ".join(rows[0]) + " |", "|" + "---|" * len(rows[0]), *("| " + " | ".join(map(_cell, r)) + " |" for r in rows[1:]), ""]
    report = folder / "report.md"
    report.write_text("\n".join(lines))
    return report
