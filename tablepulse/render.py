"""Reports as text: JSON, a terminal table, workflow annotations and costs. Driver side, from collected rows."""

from __future__ import annotations

import json

from .functions.formatting import bytes_text, number_text

MARKS = {"PASS": "ok", "WARNING": "! ", "CRITICAL": "!!", "ERROR": "??"}


def message(finding: dict) -> str:
    """One line on a finding, from its numbers."""
    d = json.loads(finding["details"]) if isinstance(finding["details"], str) else finding["details"]
    parts = []
    for k, v in d.items():
        if isinstance(v, (list, dict)):
            continue
        if isinstance(v, float):
            v = f"{v:.1f}"
        elif isinstance(v, int) and ("bytes" in k):
            v = bytes_text(v)
        elif isinstance(v, int):
            v = number_text(v)
        parts.append(f"{k.replace('_', ' ')} {v}")
    return f"{finding['check_name']}: {', '.join(parts[:5]) or 'nothing to report'}"


def as_json(report: object) -> str:
    return json.dumps(report, indent=2, default=str)


def pretty(report: dict) -> str:
    s = report["summary"]
    head = f"{report['table_name']}  {report['overall']['severity']}"
    counts = f"{number_text(s['data_file_count'])} files, {bytes_text(s['total_size_bytes'])}, {number_text(s['total_record_count'])} rows, {s['snapshot_count']} snapshots"
    lines = [head, counts, ""]
    for f in report["findings"]:
        lines.append(f"{MARKS[f['severity']]} {message(f)}")
        lines += [f"     {f[c]}" for c in ("fix_suggestion", "fix_command", "estimated_savings") if f.get(c)]
    for u in report.get("unreadable") or []:
        lines.append(f"{MARKS['ERROR']} {u['path']}: {u['error']}")
    width = max(map(len, lines))
    return "\n".join(["+" + "-" * (width + 2) + "+", *(f"| {x.ljust(width)} |" for x in lines), "+" + "-" * (width + 2) + "+"])


def github(report: dict) -> str:
    """Workflow annotations; what passes is left out."""
    kinds = {"WARNING": "warning", "CRITICAL": "error"}
    return "\n".join(f"::{kinds[f['severity']]} title={report['table_name']} {f['check_id']}::{message(f)}" for f in report["findings"] if f["severity"] in kinds)


def costs(table_name: str, items: list[dict], currency: str = "USD") -> str:
    total = sum(i["monthly_cost"] for i in items)
    rows = [(i["category"].replace("_", " "), f"${i['monthly_cost']:.4f}") for i in items] + [("total per month", f"${total:.4f}")]
    width = max(len(a) for a, _ in rows)
    return "\n".join([f"{table_name} ({currency})", *(f"  {a.ljust(width)}  {b}" for a, b in rows)])
