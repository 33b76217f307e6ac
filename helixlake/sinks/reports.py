"""Reports: their lines are made by tasks and put together to one file."""

from __future__ import annotations

import html
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixlake import storage
from helixlake.functions.text import html_escape, rs_label
from helixlake.operators.diff import diff_line, diff_summary, first_changes
from helixlake.schemas import LOOKUP_COLUMNS

STYLE = "body{font-family:sans-serif;margin:2em}table{border-collapse:collapse;width:100%}th{text-align:left;cursor:pointer;background:#123;color:#fff}td,th{padding:.5em;border-bottom:1px solid #ccc}.count{text-align:right}.empty{text-align:center}"
SCRIPT = """document.querySelectorAll('#coverage th').forEach((head, column) => head.onclick = () => {
  const body = document.querySelector('#coverage tbody'), up = head.dataset.up !== '1', number = head.dataset.type === 'number';
  head.dataset.up = up ? '1' : '0';
  const key = row => { const cell = row.cells[column]; return number ? +(cell.dataset.sortValue ?? cell.textContent) : cell.textContent; };
  const order = (a, b) => number ? key(a) - key(b) : key(a).localeCompare(key(b));
  body.append(...[...body.rows].sort((a, b) => up ? order(a, b) : order(b, a)));
});"""
#: What the reports say.
TITLE, NO_ROWS = "RSID Coverage Report", "No rsid data available"
COLUMNS = [("string", "Format"), ("string", "RSID / Marker"), ("number", "Observations")]
DIFF_LABELS = {"baseline_rows": "Baseline rows", "candidate_rows": "Candidate rows", "missing": "Missing in candidate", "added": "Not present in baseline", "differences": "Genotype/position differences"}


def html_rows(coverage: DataFrame) -> DataFrame:
    """coverage (format, rsid, count) as html, one table row each."""
    n = F.col("count").cast("string")
    row = F.concat(F.lit("<tr><td>"), html_escape(F.col("format")), F.lit("</td><td>"), rs_label(F.col("rsid")), F.lit('</td><td class="count" data-sort-value="'), n, F.lit('">'), n, F.lit("</td></tr>"))
    return coverage.select("format", "rsid", row.alias("html"))


def write_html_report(path: str, coverage: DataFrame, counts: dict, source: str, generated_at: str | None = None) -> None:
    """coverage in its order; counts: unique_formats, unique_rsids, total_rows."""
    if not Path(path).suffix:
        raise ValueError("the report's path needs an ending")
    at = generated_at or datetime.now(timezone.utc).isoformat()
    head = "".join(f'<th data-type="{kind}">{name}</th>' for kind, name in COLUMNS)
    before = (f'<!DOCTYPE html>\n<html lang="en"><head><meta charset="utf-8"><title>{TITLE}</title><style>{STYLE}</style></head><body>\n<h1>{TITLE}</h1>\n'
              f"<p>Source database: <b>{html.escape(source)}</b><br>Generated at: <b>{html.escape(at)}</b><br>Formats tracked: <b>{counts['unique_formats']}</b>, "
              f"Unique rsids: <b>{counts['unique_rsids']}</b>, Format/rsid rows: <b>{counts['total_rows']}</b></p>\n"
              f'<table id="coverage"><thead><tr>{head}</tr></thead><tbody>\n')
    none = "" if counts["total_rows"] else f'<tr><td colspan="3" class="empty">{NO_ROWS}</td></tr>\n'
    storage.write_text_file(html_rows(coverage).select("html"), str(path), before, f"{none}</tbody></table>\n<script>{SCRIPT}</script></body></html>\n")


def write_summary_json(path: str, summary: DataFrame) -> None:
    text = summary.select(F.to_json(F.struct("*"), {"pretty": "true", "ignoreNullFields": "false"})).first()[0]
    storage.write_bytes(summary.sparkSession, str(path), f"{text}\n".encode())


def csv_line(columns: list[str]):
    """Values quoted where they hold commas, quotes or line breaks, with quotes doubled; blanks stay blank."""
    return F.to_csv(F.struct(*columns), {"escape": '"', "emptyValue": "", "nullValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"})


def write_routed_csv(lookup: DataFrame, exact_path: str, other_path: str, order: list[str] | None = None) -> dict[str, int]:
    """Exact rows to one file, all others to the other, by order; a file without rows stays empty, without a header.

    The lookup is computed once, and stored.
    """
    rows = storage.stored(lookup, "routed")
    counts = rows.agg(F.count_if(F.col("status") == "exact").alias("exact"), F.count_if(F.col("status") != "exact").alias("other")).first().asDict()
    for name, path, rule in (("exact", exact_path, "status = 'exact'"), ("other", other_path, "status <> 'exact'")):
        own = rows.where(rule)
        lines = (own.orderBy(*order) if order else own).select(csv_line(LOOKUP_COLUMNS).alias("line"))
        storage.write_text_file(lines, str(path), ",".join(LOOKUP_COLUMNS) + "\r\n" if counts[name] else "", line_end="\r\n")
    return counts


def diff_report(compared: DataFrame, limit: int = 20) -> str:
    """Five counters, the first differences, how many more there are, and the first missing and new rsids."""
    c = diff_summary(compared).first()
    out = [f"{label}: {c[name]:,}" for name, label in DIFF_LABELS.items()]
    out += [r["line"] for r in first_changes(compared, "changed", limit).select(diff_line().alias("line")).collect()]
    if c["differences"] > limit:
        out.append(f"... {c['differences'] - limit} more differences omitted")
    for change, text in (("missing", "missing"), ("added", "new")):
        if c[change]:
            out.append(f"Sample {text} rsids: " + ", ".join(r["rsid"] for r in first_changes(compared, change, limit).collect()))
    return "\n".join(out)
