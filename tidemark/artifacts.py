"""Files of a run: observations as CSV, a summary as JSON with the digest of the raw file, a failure log, a manifest of
digests, their verification and comparison, and tables in Markdown. Observations are summaries and small; results of any
size go through DataFrame writers.
"""

from __future__ import annotations

import csv
import hashlib
import json
import platform
import statistics
import subprocess
import time
from collections.abc import Callable, Iterable
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

MANIFEST = "SHA256.json"
TIMINGS = {"runtime_ms", "runtime_samples_ms"}


def plain(value):
    """Rows and dates as what JSON knows."""
    if hasattr(value, "asDict"):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value.isoformat() if isinstance(value, datetime) else value


def rows_of(df: DataFrame) -> list[dict]:
    return [plain(r) for r in df.collect()]


def file_digest(path: Path) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def digest(value) -> str:
    """SHA-256 of a value's JSON with sorted keys."""
    return hashlib.sha256(json.dumps(value, sort_keys=True).encode()).hexdigest()


def cell(value) -> str:
    """How CSV files show a value: nested ones as JSON, nulls as nothing."""
    if value is None:
        return ""
    return json.dumps(value, sort_keys=True) if isinstance(value, (dict, list)) else str(value)


def write_csv(path: Path, rows: list[dict]) -> None:
    """Rows that may lack fields: the columns are all fields, sorted."""
    fields = sorted({k for r in rows for k in r})
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f, lineterminator="\n")
        out.writerow(fields)
        out.writerows([cell(r.get(k)) for k in fields] for r in rows)


def write_table(df: DataFrame, path: str) -> None:
    """A DataFrame of any size as CSV parts; nested columns as JSON. An existing folder is an error."""
    nested = [x.name for x in df.schema if isinstance(x.dataType, (ArrayType, MapType, StructType))]
    df.withColumns({c: F.to_json(c) for c in nested}).write.mode("errorifexists").csv(path, header=True)


def union_ragged(first: DataFrame, *more: DataFrame) -> DataFrame:
    first = first.select("*")  # a bare range is typed and takes no columns
    for df in more:
        first = first.unionByName(df.select("*"), allowMissingColumns=True)
    return first.select(*sorted(first.columns))


def write_json(path: Path, value, fresh: bool = False) -> None:
    with open(path, "x" if fresh else "w", encoding="utf-8") as f:
        json.dump(value, f, indent=2, sort_keys=True, allow_nan=False)
        f.write("\n")


def commit() -> str:
    try:
        return subprocess.check_output(["git", "rev-parse", "HEAD"], text=True, stderr=subprocess.DEVNULL).strip()
    except (OSError, subprocess.CalledProcessError):
        return "unknown"


def metadata(**settings) -> dict:
    return {"generated_at": datetime.now(timezone.utc).isoformat(), "commit": commit(), "python": platform.python_version(), "platform": platform.platform(), **settings}


def timed(work: Callable, repeats: int) -> tuple[object, dict]:
    """The last result of work and its times in ms."""
    samples, result = [], None
    for _ in range(repeats):
        began = time.perf_counter_ns()
        result = work()
        samples.append((time.perf_counter_ns() - began) / 1e6)
    return result, {"runtime_ms_median": round(statistics.median(samples), 6), "runtime_ms_mean": round(statistics.fmean(samples), 6), "timing_repeats": repeats}


def record(folder: str, groups: Callable[[], dict[str, list[dict]]], **settings) -> Path:
    """Write the groups of observations that the callable makes to a new folder, with a manifest. If it fails, its error
    is written and raised."""
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=False)
    try:
        made = groups()
        if not any(made.values()):
            raise ValueError("no observations produced")
        write_json(out / "results.json", {"metadata": metadata(**settings), **made})
        for name, rows in made.items():
            write_csv(out / f"{name}.csv", rows)
        write_json(out / MANIFEST, {p.name: file_digest(p) for p in out.iterdir()})
    except Exception as e:
        write_json(out / "failure.json", {"error": repr(e)})
        raise
    return out


def summarize(folder: str, name: str, observations: list[dict], summary: list[dict], failures: list = (), **settings) -> Path:
    """Raw CSV, summary JSON with the raw file's digest, and the failures, even if there are none."""
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    raw = out / f"{name}.csv"
    write_csv(raw, observations)
    write_json(out / f"{name}-failures.json", list(failures))
    path = out / f"{name}-summary.json"
    write_json(path, {**metadata(**settings), "observation_count": len(observations), "failure_count": len(failures), "raw_sha256": file_digest(raw), "results": summary})
    return path


def verify(folder: str, groups: Iterable[str] = ("principal", "bounded")) -> dict:
    """The results of a recorded run whose files all have their digests and whose CSV says what its JSON does."""
    out, groups = Path(folder), list(groups)
    known = json.loads((out / MANIFEST).read_text(encoding="utf-8"))
    if set(known) != {"results.json", *(f"{g}.csv" for g in groups)}:
        raise ValueError("unexpected artifact manifest entries")
    for name, value in known.items():
        if file_digest(out / name) != value:
            raise ValueError(f"hash mismatch: {name}")
    data = json.loads((out / "results.json").read_text(encoding="utf-8"))
    for g in groups:
        fields = sorted({k for r in data[g] for k in r})
        with open(out / f"{g}.csv", newline="", encoding="utf-8") as f:
            header, *found = list(csv.reader(f)) or [[]]
        if len(found) != len(data[g]):
            raise ValueError(f"row count mismatch: {g}")
        if header != fields or any(line != [cell(r.get(k)) for k in fields] for line, r in zip(found, data[g])):
            raise ValueError(f"CSV/JSON mismatch: {g}")
    return data


def compare(original: str, reproduced: str, groups: Iterable[str] = ("principal", "bounded"), settings: Iterable[str] = ()) -> dict:
    """Whether two verified runs have one configuration and, apart from times, one outcome."""
    groups = list(groups)
    old, new = verify(original, groups), verify(reproduced, groups)
    for name in settings:
        if old["metadata"].get(name) != new["metadata"].get(name):
            raise ValueError(f"baseline configuration changed: {name}")
    for g in groups:
        a, b = ([{k: v for k, v in r.items() if k not in TIMINGS} for r in x[g]] for x in (old, new))
        if a != b:
            raise ValueError(f"non-timing outcomes differ: {g}")
    return {"status": "identical_non_timing_outcomes", "counts": {g: len(old[g]) for g in groups}, "original_metadata": old["metadata"], "reproduced_metadata": new["metadata"]}


def preserved(root: str, manifest: str) -> dict:
    """Whether all files named in a manifest ({"files": {name: digest}}) are as they were."""
    listed = json.loads(Path(manifest).read_text(encoding="utf-8"))
    base = Path(root)
    changed = [n for n, d in sorted(listed["files"].items()) if not (base / n).is_file() or file_digest(base / n) != d]
    if changed:
        raise ValueError("protected files changed: " + ", ".join(changed))
    return {"status": "preserved", "files_checked": len(listed["files"]), "base_commit": listed.get("base_commit")}


def markdown(summary: dict, columns: list[str] | None = None) -> str:
    """A summary's results as a table."""
    rows = summary["results"]
    columns = columns or list(dict.fromkeys(k for r in rows for k in r))
    lines = ["# Experiment summary", "", f"- Commit: `{summary['commit']}`", f"- Python: {summary['python']}", f"- Observations: {summary['observation_count']}", ""]
    lines += ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    lines += ["| " + " | ".join(cell(r.get(c)) for c in columns) + " |" for r in rows]
    return "\n".join(lines) + "\n"
