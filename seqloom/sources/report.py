"""Report sinks: the fixed-layout CSV, a static HTML page, and the run's figures as JSON."""

from __future__ import annotations

import json
import os
import resource
import shutil
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.constants import FAMILY_INTERVAL, FAMILY_MISS, TOP_ROWS
from seqloom.functions.stats import decimal_text, decimal_text_udf, least_fraction, outward_lower_udf, outward_upper_udf, shortest_text_udf


@dataclass(frozen=True)
class RunSummary:
    """What a run leaves: its fragments, those selected, the supported groups and the report's folder."""

    input_fragments: int
    selected: int
    rows: int
    report: str


# The report's columns in order.
COLUMNS = (
    "sample_id reference_description reference_id support_rank support_fragments support_pct target_support_share_pct coverage_pct covered_bp "
    "reference_length_bp occupied_windows window_count support_ci_lower_pct support_ci_upper_pct split_support_fragments discordant_fragments "
    "reference_member_count reference_member_ids input_mode input_fragments selected_fragments total_target_support_fragments "
    "supported_reference_groups sampling_target_score"
).split()


def report_rows(estimates: DataFrame) -> DataFrame:
    """estimates (see plans.run) in the report's 24 text columns, one row a supported group, ranked; run_id stays in front.

    Only the panel's rows pass here, so text is made by small functions over columns.
    """
    pct = lambda c, places=6: decimal_text_udf(c, F.lit(places))
    text = {
        "sample_id": F.col("run_id"),
        "reference_description": F.coalesce("representative_description", F.lit("")),
        "reference_id": F.col("representative_id"),
        "support_rank": F.col("support_rank"),
        "support_fragments": F.col("supporting_selected_fragments"),
        "support_pct": pct(F.col("fraction") * 100, 10),
        "target_support_share_pct": pct("target_support_share_pct"),
        "coverage_pct": pct(F.col("covered_bases") * 100.0 / F.col("representative_length")),
        "covered_bp": F.col("covered_bases"),
        "reference_length_bp": F.col("representative_length"),
        "occupied_windows": F.col("occupied_windows"),
        "window_count": F.lit("10"),
        "support_ci_lower_pct": outward_lower_udf(F.col("lower_count") / F.col("input_fragments")),
        "support_ci_upper_pct": outward_upper_udf(F.col("upper_count") / F.col("input_fragments")),
        "split_support_fragments": F.col("split_events"),
        "discordant_fragments": F.col("discordant_fragments"),
        "reference_member_count": F.size("member_ids"),
        "reference_member_ids": F.array_join("member_ids", ";"),
        "input_mode": F.col("input_mode"),
        "input_fragments": F.col("input_fragments"),
        "selected_fragments": F.col("selected"),
        "total_target_support_fragments": F.col("total_target_support_fragments"),
        "supported_reference_groups": F.col("supported_reference_groups"),
        "sampling_target_score": shortest_text_udf("sampling_target_score"),
    }
    return estimates.select("run_id", *[c.cast("string").alias(n) for n, c in text.items()])


def _quoted(v: str | None) -> str:
    v = v or ""
    return '"' + v.replace('"', '""') + '"' if any(c in v for c in ',"\r\n') else v


def csv_bytes(rows: list[dict], run: dict) -> bytes:
    """BOM, header, CRLF; the ranked rows, or one row that names the sample alone."""
    rows = rows or [{"sample_id": run["run_id"], "input_mode": run["input_mode"], "input_fragments": str(run["input_fragments"]), "selected_fragments": str(run["selected"]), "total_target_support_fragments": "0", "supported_reference_groups": "0"}]
    lines = [",".join(COLUMNS), *[",".join(_quoted(r.get(c)) for c in COLUMNS) for r in rows]]
    return "﻿".encode() + "".join(x + "\r\n" for x in lines).encode()


def _escaped(v: str | None) -> str:
    return (v or "").replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


# The names of a run's fields in order.
RUN_FIELDS = (
    "schema_id record_type sample_id analysis_status reason_codes input_mode input_fragments selected_fragments precision mode sample_capacity "
    "sampling_population_fragments sampling_expected_support sampling_population selection_probability minimum_relevant_fraction "
    "familywise_miss_probability interval_level target_family_size prescreen_passed_fragments aligned_fragments unassigned_fragments "
    "profile_digest index_digest input_digest read_ends_per_fragment"
).split()

# The names of a target's fields in order.
TARGET_FIELDS = (
    "target_group_id record_type representative_id representative_description member_ids evidence_status attribution_status "
    "supporting_selected_fragments selected_fragment_denominator attributed_fragment_fraction interval_lower interval_upper interval_level "
    "interval_method estimated_input_supporting_fragments covered_bases representative_length coverage_fraction occupied_windows "
    "host_confounded_fragments cross_group_ambiguous_fragments integration_status split_events discordant_fragments limitation_codes "
    "sampling_target_score"
).split()

# The names of a run's performance fields in order.
PERF_FIELDS = (
    "schema_id status sample_id wall_time_ms configured_threads process_cpu_time_ms peak_rss_bytes read_bytes written_bytes index_load_ms "
    "scan_sample_ms selected_analysis_ms report_write sampling_peak_buffered_fragments input_fragments selected_fragments "
    "prescreen_passed_fragments aligned_fragments telemetry_status sample_errors"
).split()

SCHEMA_ID, PERF_SCHEMA_ID = "seqloom.evidence-report.v1", "seqloom.perf.v1"
# How intervals are made, and what a sample of each mode stands for.
INTERVAL_METHOD = "EQUAL_TAILED_EXACT_HYPERGEOMETRIC_INVERSION"
POPULATIONS = {"full": "bloom_candidates", "screen": "input_fragments"}


def run_fields(run: dict) -> dict[str, str]:
    """The 26 fields of a run's record as texts; run holds the figures of plans.run and the run's digests."""
    number = lambda v: "" if v is None else decimal_text(float(v), 17)
    values = {
        "schema_id": SCHEMA_ID, "record_type": "RUN", "sample_id": run["run_id"], "analysis_status": run["analysis_status"], "reason_codes": run["reason_codes"],
        "input_mode": run["input_mode"], "input_fragments": run["input_fragments"], "selected_fragments": run["selected"], "precision": run["precision"], "mode": run["mode"],
        "sample_capacity": run["sample_capacity"], "sampling_population_fragments": run["population"], "sampling_expected_support": number(run["expected_support"]),
        "sampling_population": POPULATIONS[run["mode"]], "selection_probability": number(run["selection_probability"]),
        "minimum_relevant_fraction": number(least_fraction(run["precision"])), "familywise_miss_probability": number(FAMILY_MISS), "interval_level": number(1.0 - FAMILY_INTERVAL),
        "target_family_size": run["target_family_size"], "prescreen_passed_fragments": run["passed"], "aligned_fragments": run["aligned_fragments"],
        "unassigned_fragments": run["unassigned_fragments"], "profile_digest": run["profile_digest"], "index_digest": run["index_digest"], "input_digest": run["input_digest"],
        "read_ends_per_fragment": 2 if run["input_mode"] == "PE" else 1,
    }
    return {name: str(values[name]) for name in RUN_FIELDS}


def target_rows(estimates: DataFrame) -> DataFrame:
    """estimates (see plans.run) in the 26 text fields of a target's record, one row a supported group; run_id and support_rank stay in front."""
    precise = lambda c: decimal_text_udf(c, F.lit(17))
    text = {
        "target_group_id": F.col("target_group_id"),
        "record_type": F.lit("TARGET_SIGNAL"),
        "representative_id": F.col("representative_id"),
        "representative_description": F.coalesce("representative_description", F.lit("")),
        "member_ids": F.array_join("member_ids", ";"),
        "evidence_status": F.col("evidence_status"),
        "attribution_status": F.col("attribution_status"),
        "supporting_selected_fragments": F.col("supporting_selected_fragments"),
        "selected_fragment_denominator": F.col("selected"),
        "attributed_fragment_fraction": precise(F.col("fraction")),
        "interval_lower": precise(F.col("lower_count") / F.col("input_fragments")),
        "interval_upper": precise(F.col("upper_count") / F.col("input_fragments")),
        "interval_level": precise(F.col("interval_level")),
        "interval_method": F.lit(INTERVAL_METHOD),
        "estimated_input_supporting_fragments": precise(F.col("estimated_fragments")),
        "covered_bases": F.col("covered_bases"),
        "representative_length": F.col("representative_length"),
        "coverage_fraction": precise(F.col("covered_bases") / F.col("representative_length")),
        "occupied_windows": F.col("occupied_windows"),
        "host_confounded_fragments": F.col("host_confounded_fragments"),
        "cross_group_ambiguous_fragments": F.col("cross_group_ambiguous_fragments"),
        "integration_status": F.col("integration_status"),
        "split_events": F.col("split_events"),
        "discordant_fragments": F.col("discordant_fragments"),
        "limitation_codes": F.lit(""),
        "sampling_target_score": shortest_text_udf("sampling_target_score"),
    }
    return estimates.select("run_id", F.col("support_rank").cast("int").alias("support_rank"), *[c.cast("string").alias(n) for n, c in text.items()])


def top_targets(targets: DataFrame, most: int = TOP_ROWS) -> DataFrame:
    """The target records of the groups on each run's short list: of the top rows' representatives, in order of rank."""
    shown = targets.filter(F.col("support_rank") <= most).select(F.col("run_id").alias("_run"), F.col("representative_id").alias("_shown")).distinct()
    return targets.join(shown, F.col("run_id").eqNullSafe(F.col("_run")) & (F.col("representative_id") == F.col("_shown")), "left_semi")


def _table(fields: dict[str, str]) -> str:
    return "<table>" + "".join(f'<tr><th>{_escaped(k)}</th><td data-field="{_escaped(k)}">{_escaped(v)}</td></tr>' for k, v in fields.items()) + "</table>"


def _signal(row: dict) -> str:
    """One row of the short list: a summary and its 24 fields."""
    shown = {k: _escaped(row.get(k)) for k in COLUMNS}
    title = shown["reference_description"] or shown["reference_id"]
    head = f'{shown["support_rank"]}. {title} ({shown["reference_id"]}): {shown["support_fragments"]} fragments, {shown["support_pct"]}% [{shown["support_ci_lower_pct"]}%, {shown["support_ci_upper_pct"]}%]'
    return f"<details><summary>{head}</summary>{_table({k: row.get(k) or '' for k in COLUMNS})}</details>"


def html_bytes(rows: list[dict], run: dict, csv: bytes, targets: list[dict] | None = None) -> bytes:
    """A static page: the run's overview, the short list with its fields, all run fields, the target records of the short list, and the whole CSV as a data link.

    Every value is escaped and put in once, so nothing in the data is ever taken for markup or a template.
    """
    shown = rows[:TOP_ROWS]
    none = "No fragment was selected." if not run["selected"] else "No selected fragment passed the gate." if not run.get("passed") else "No selected fragment was attributed to a target group."
    link = "data:text/csv;charset=utf-8," + "".join(f"%{b:02X}" for b in csv)
    sampled = "Sampled candidates" if run["mode"] == "full" else "Sampled input fragments"
    overview = {"Input fragments": str(run["input_fragments"]), sampled: str(run["selected"]), "Attributed target fragments": str(sum(int(r["support_fragments"]) for r in rows)), "Shown groups": f"{len(shown)} of {len(rows)}"}
    audit = "".join(f'<section data-group="{_escaped(t["target_group_id"])}"><h4>{_escaped(t["representative_id"])}</h4>{_table({k: t[k] for k in TARGET_FIELDS})}</section>' for t in targets or [])
    name = _escaped(run["run_id"])
    page = (
        f'<!doctype html><html lang="en"><meta charset="utf-8"><title>{name}</title><h1>{name}</h1>{_table(overview)}<a download="{name}.csv" href="{link}">CSV</a>'
        f"<h2>Reference signals</h2>{''.join(map(_signal, shown)) or f'<p>{none}</p>'}"
        f'<h2>Run</h2><section id="run">{_table(run_fields(run))}</section><h2>Targets</h2><section id="targets">{audit}</section></html>'
    )
    return page.encode()


class Performance:
    """The clock of a run: stages, and the driver's own process figures."""

    def __init__(self, threads: int):
        self.threads, self.began, self.cpu = threads, time.time(), time.process_time()
        self.stages = dict.fromkeys(("index_load_ms", "scan_sample_ms", "selected_analysis_ms", "report_write"), 0)
        self._last = self.began

    def stage(self, name: str) -> None:
        """The time since the last stage ended goes to this one."""
        now = time.time()
        self.stages[name] += int(1000 * (now - self._last))
        self._last = now

    def fields(self, status: str, run: dict, errors: list[str]) -> dict:
        """The 20 fields; the process figures are the driver's, the executors' are in Spark's own metrics."""
        try:
            with open("/proc/self/io") as f:
                io = dict(line.split(": ") for line in f.read().splitlines())
            complete = True
        except OSError:
            io, complete = {}, False
        values = {
            "schema_id": PERF_SCHEMA_ID, "status": status, "sample_id": run.get("run_id", ""), "wall_time_ms": int(1000 * (time.time() - self.began)), "configured_threads": self.threads,
            "process_cpu_time_ms": int(1000 * (time.process_time() - self.cpu)), "peak_rss_bytes": 1024 * resource.getrusage(resource.RUSAGE_SELF).ru_maxrss,
            "read_bytes": int(io.get("read_bytes", 0)), "written_bytes": int(io.get("write_bytes", 0)), **self.stages, "sampling_peak_buffered_fragments": run.get("selected", 0),
            "input_fragments": run.get("input_fragments", 0), "selected_fragments": run.get("selected", 0), "prescreen_passed_fragments": run.get("passed", 0),
            "aligned_fragments": run.get("aligned_fragments", 0), "telemetry_status": "COMPLETE" if complete else "UNAVAILABLE", "sample_errors": errors,
        }
        return {name: values[name] for name in PERF_FIELDS}


def atomic_write(path: str, data: bytes) -> None:
    """Write beside the target, then rename."""
    part = f"{path}.part.{os.getpid()}"
    with open(part, "xb") as f:
        f.write(data)
    os.replace(part, path)


def write_failure(out: str, error: Exception, clock: Performance, sample: str = "") -> None:
    """The new folder `out` with perf.json alone, which has the error."""
    os.makedirs(out)
    perf = clock.fields("ERROR", {"run_id": sample}, [str(error)[:2000]])
    atomic_write(f"{out}/perf.json", json.dumps(perf, indent=2).encode() + b"\n")


def write_report(estimates: DataFrame, run: dict, out: str, clock: Performance | None = None) -> RunSummary:
    """report.csv, report.html and perf.json of one run in the new folder `out`, which appears whole or not at all.

    The rows collected are one a supported group of the panel. The files are written beside `out` and the folder is
    renamed at last.
    """
    clock = clock or Performance(1)
    if os.path.exists(out):
        raise FileExistsError(out)
    own = estimates.filter(F.col("run_id") == run["run_id"])
    part = f"{out.rstrip('/')}.part.{os.getpid()}"
    os.makedirs(part)
    try:
        rows = [r.asDict() for r in report_rows(own).orderBy(F.col("support_rank").cast("int")).collect()]
        targets = [r.asDict() for r in top_targets(target_rows(own)).orderBy("support_rank").collect()]
        csv = csv_bytes(rows, run)
        atomic_write(f"{part}/report.csv", csv)
        atomic_write(f"{part}/report.html", html_bytes(rows, run, csv, targets))
        clock.stage("report_write")
        atomic_write(f"{part}/perf.json", json.dumps(clock.fields("SUCCESS", run, []), indent=2).encode() + b"\n")
        os.rename(part, out)
    except Exception:
        shutil.rmtree(part)
        raise
    return RunSummary(run["input_fragments"], run["selected"], len(rows), out)
