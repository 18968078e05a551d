"""Command line: `python -m tidemark.cli COMMAND`. One JSON object goes to standard output; the exit code is 0 for pass,
1 for data that fail and 2 for input that can't be checked.

`SETTINGS` says of each setting how it is written and which values it may have; `COMMANDS` says which settings a command
takes and what it does. Values come from the command line or, for checks, from a JSON object named by --config.
"""

from __future__ import annotations

import argparse
import csv
import json
import math
import os
import sys
from collections import ChainMap
from typing import Any, Callable, NamedTuple

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import instant, isoformat
from .operators import checks
from .session import session
from .sources import strict_csv

VERSION = "1.0"
# The built-in example.
EXAMPLE = [("a", "2026-01-01T00:00:00Z", "true"), ("a", "2026-01-01T01:00:00Z", "true"), ("", "2026-01-01T02:00:00Z", "false")]
EXAMPLE_COLUMNS = ["id", "event_ts", "is_current"]


class Setting(NamedTuple):
    written: dict[str, Any]
    fits: Callable[[Any], bool]
    wrong: str
    absent: Any = None


def flag(name: str, **written) -> Setting:
    return Setting(written, lambda v: isinstance(v, bool), f"{name} must be a boolean", False)


def column(name: str) -> Setting:
    return Setting({}, lambda v: isinstance(v, str) and v != "", f"{name} is required")


def whole(default: int, fits: Callable[[int], bool] = lambda v: True, wrong: str = "") -> Setting:
    return Setting({"type": int}, fits, wrong, default)


def distinct_names(value) -> bool:
    return isinstance(value, list) and value != [] and all(isinstance(v, str) and v for v in value) and len(set(value)) == len(value)


def span(value) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool) and 0 <= value < math.inf


# Names of settings, defaults, limits.
SETTINGS = {
    "csv": Setting({"help": "a CSV file or a folder of them"}, lambda v: v is None or (isinstance(v, str) and v != ""), "csv must be a file path"),
    "synthetic": flag("synthetic", action="store_true", help="the built-in example"),
    "keys": Setting({"nargs": "+"}, distinct_names, "keys must be a nonempty list of distinct column names"),
    "strict": flag("strict", action=argparse.BooleanOptionalAction),
    "current_column": column("current_column"),
    "timestamp_column": column("timestamp_column"),
    "max_age_seconds": Setting({"type": float}, span, "max_age_seconds must be a finite nonnegative number"),
    "now": Setting({"help": "ISO 8601 time with a zone"}, lambda v: v is None or isinstance(v, str), "timestamps must be ISO 8601 with a timezone"),
    "seed": whole(7),
    "interrupt_after": whole(5),
    "checkpoint_after": whole(2),
    "port": whole(8765, lambda v: 0 <= v <= 65535, "port must be 0..65535"),
}
SOURCES = ("csv", "synthetic")


def source(spark: SparkSession, chosen: dict, columns: list[str]) -> DataFrame:
    if chosen["synthetic"]:
        if set(columns) - set(EXAMPLE_COLUMNS):
            raise ValueError("synthetic columns are " + ", ".join(EXAMPLE_COLUMNS))
        return spark.createDataFrame([(*r, n) for n, r in enumerate(EXAMPLE, 1)], ", ".join(f"{c} string" for c in EXAMPLE_COLUMNS) + ", row_no long")
    strict_csv.header(strict_csv.files(chosen["csv"])[0], tuple(columns))  # before any job
    strict_csv.register(spark)
    return spark.read.format("strict_csv").option("path", chosen["csv"]).option("required", ",".join(columns)).load()


def duplicate_keys(df: DataFrame, chosen: dict) -> dict:
    return checks.duplicate_keys(df, chosen["keys"], chosen["strict"]).first().asDict()


def null_keys(df: DataFrame, chosen: dict) -> dict:
    sample = checks.null_key_sample(df, chosen["keys"], "row_no").collect()
    return checks.null_keys(df, chosen["keys"]).first().asDict() | {"sample_row_numbers": [r.row_number for r in sample]}


def duplicate_current(df: DataFrame, chosen: dict) -> dict:
    return checks.duplicate_current(df, chosen["keys"], chosen["current_column"], chosen["strict"], "row_no").first().asDict()


def freshness(df: DataFrame, chosen: dict) -> dict:
    at, now = chosen["timestamp_column"], F.current_timestamp()
    if chosen["now"] is not None:
        now = instant(F.lit(chosen["now"]))
        if df.sparkSession.range(1).select(now.isNull()).first()[0]:
            raise ValueError(SETTINGS["now"].wrong)
    found = checks.freshness(df, at, chosen["max_age_seconds"], now, "row_no").drop("latest_timestamp").first().asDict()
    # the latest instant keeps the offset it was written with
    latest = df.agg(F.max_by(isoformat(at), F.struct(instant(at), -F.col("row_no")))).first()[0]
    return found | {"latest_timestamp": latest}


def checking(look: Callable[[DataFrame, dict], dict]):
    """A command that looks at the columns its settings name and reports whether they pass."""

    def run(spark: SparkSession, command: str, chosen: dict):
        columns = list(chosen.get("keys", [])) + [chosen[c] for c in ("timestamp_column", "current_column") if c in chosen]
        # every row must parse and be known before its check counts; a few columns of one file fit the cache or are read again
        df = source(spark, chosen, columns).select(*dict.fromkeys(columns), "row_no").cache()
        try:
            if df.isEmpty():
                raise ValueError("dataset is empty")
            result = look(df, chosen)
        finally:
            df.unpersist()
        return result["passed"], envelope(command, "pass" if result["passed"] else "fail", result=result)

    return run


def demonstrate(spark: SparkSession, command: str, chosen: dict):
    from .plans import lab

    out = lab.demonstrate(spark, **chosen)
    return out["result"]["passed"], out


def serve(spark: SparkSession, command: str, chosen: dict):
    from . import server

    server.serve(spark, chosen["port"])
    return True, None


class Command(NamedTuple):
    takes: tuple[str, ...]
    run: Callable[[SparkSession, str, dict], tuple[bool, dict | None]]


# Names of commands and what each takes.
COMMANDS = {
    "duplicate-keys": Command((*SOURCES, "keys", "strict"), checking(duplicate_keys)),
    "null-keys": Command((*SOURCES, "keys"), checking(null_keys)),
    "freshness": Command((*SOURCES, "timestamp_column", "max_age_seconds", "now"), checking(freshness)),
    "duplicate-current": Command((*SOURCES, "keys", "current_column", "strict"), checking(duplicate_current)),
    "cdc-demo": Command(("seed", "interrupt_after", "checkpoint_after"), demonstrate),
    "serve": Command(("port",), serve),
}


class Reader(argparse.ArgumentParser):
    def error(self, message):
        raise ValueError(message)


def reader() -> Reader:
    """Reads what is written only: settings that are not are left out, whatever their defaults."""
    root = Reader(prog="tidemark", description="Checks of data files and replay experiments.")
    each = root.add_subparsers(dest="command", required=True, parser_class=Reader)
    for name, command in COMMANDS.items():
        one = each.add_parser(name, argument_default=argparse.SUPPRESS)
        for setting in command.takes:
            one.add_argument("--" + setting.replace("_", "-"), **SETTINGS[setting].written)
        if "csv" in command.takes:
            one.add_argument("--config", help="JSON object; options given here go before its values")
    return root


def configured(path: str, takes: tuple[str, ...]) -> dict:
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    if not isinstance(found, dict):
        raise ValueError("configuration must be a JSON object")
    if unknown := sorted(found.keys() - set(takes)):
        raise ValueError("unknown configuration fields: " + ", ".join(unknown))
    return found


def settle(written: dict, takes: tuple[str, ...]) -> dict:
    """A value for every setting a command takes: as written, else as configured, else its default."""
    path = written.pop("config", "")
    config = configured(path, takes) if path else {}
    if written.keys() & set(SOURCES):  # a source that is written replaces a configured one
        config = {k: v for k, v in config.items() if k not in SOURCES}
    chosen = ChainMap(written, config, {name: SETTINGS[name].absent for name in takes})
    for name in takes:
        if not SETTINGS[name].fits(chosen[name]):
            raise ValueError(SETTINGS[name].wrong)
    if "csv" in takes and (chosen["csv"] is None) != chosen["synthetic"]:
        raise ValueError("choose exactly one source: --csv or --synthetic")
    return {name: chosen[name] for name in takes}


def envelope(command: str | None, status: str, **content) -> dict:
    return {"schema_version": VERSION, "command": command, "status": status, **content}


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    name = None
    try:
        written = vars(reader().parse_args(arguments))
        name = written.pop("command")
        command = COMMANDS[name]
        chosen = settle(written, command.takes)
        passed, out = command.run(spark or session(os.environ.get("TIDEMARK_MASTER", "local[*]")), name, chosen)
        code = 0 if passed else 1
    except (ValueError, TypeError, OSError, KeyError, OverflowError, csv.Error, PySparkException) as e:
        out, code = envelope(name, "error", error=reason(e)), 2
    if out is not None:
        print(json.dumps(out, allow_nan=False))
    return code


def reason(error: Exception) -> str:
    """What a Python worker said, without the stack that Spark puts around it."""
    lines = [x.strip() for x in str(error).splitlines()]
    named = [x for x in lines if "CsvFormatError: " in x or x.startswith("_csv.Error: ")]
    return named[-1].split("Error: ", 1)[1] if named else lines[0] if lines else type(error).__name__


if __name__ == "__main__":
    sys.exit(main())
