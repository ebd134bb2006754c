"""The report of a comparison: a page with its figures, charts and tables, from what the simulation returns."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwork.functions import labels as L


def step_table(steps: DataFrame, simulated: DataFrame) -> DataFrame:
    """(site, time_min, time_label, runoff_m3, outflow_ls, fills): a row for each step, fills as "name: 12%" joined by bars."""
    fills = simulated.groupBy("site", "time_min").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("name", "fill_pct"))), lambda s: F.concat(s["name"], F.lit(": "), L.fixed(s["fill_pct"], 0, False), F.lit("%"))), " | ").alias("fills"))
    return steps.join(fills, ["site", "time_min"]).select("site", "time_min", L.minutes("time_min").alias("time_label"), "runoff_m3", "outflow_ls", "fills")


def headline(row: dict) -> str:
    return f"{row['captured_pct']:.1f}% of runoff captured; peak {row['peak_reduction_pct']:.1f}% lower and {row['peak_delay_hr']:.2f} h later; exits {row['exit_reduction_pct']:.1f}% less; cut less fill {row['net_m3']:,.0f} m³"


def chart(series: dict[str, list[tuple[float, float]]], title: str, marks: dict[str, float] | None = None, top: float | None = None, size: tuple[int, int] = (640, 240)) -> str:
    """Lines over time as SVG, with upright lines at ``marks``; a note instead if there is nothing to draw."""
    points = [p for line in series.values() for p in line]
    if not points:
        return f"<p>{html.escape(title)}: chart unavailable, no data</p>"
    width, height = size
    most_x, most_y = max(x for x, _ in points) or 1.0, top or max(y for _, y in points) or 1.0
    at = lambda x, y: f"{40 + x / most_x * (width - 60):.1f},{height - 30 - y / most_y * (height - 60):.1f}"
    colours = ["#c0392b", "#2471a3", "#1e8449", "#b9770e", "#6c3483", "#117a65"]
    parts = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" role="img"><title>{html.escape(title)}</title><rect width="100%" height="100%" fill="#fff"/>']
    for i, (name, line) in enumerate(series.items()):
        colour = colours[i % len(colours)]
        parts.append(f'<polyline fill="none" stroke="{colour}" stroke-width="1.5" points="{" ".join(at(x, y) for x, y in line)}"/><text x="{50 + 150 * (i % 4)}" y="{14 + 12 * (i // 4)}" font-size="11" fill="{colour}">{html.escape(name)}</text>')
    for name, x in (marks or {}).items():
        a, b = at(x, 0).split(","), at(x, most_y).split(",")
        parts.append(f'<line x1="{a[0]}" y1="{a[1]}" x2="{b[0]}" y2="{b[1]}" stroke="#888" stroke-dasharray="4"><title>{html.escape(name)}</title></line>')
    parts.append(f'<text x="4" y="{height - 30}" font-size="10">0</text><text x="4" y="34" font-size="10">{most_y:,.0f}</text><text x="{width - 60}" y="{height - 8}" font-size="10">{most_x:,.1f} h</text></svg>')
    return "".join(parts)


def _table(rows: list[dict]) -> str:
    if not rows:
        return "<p>none</p>"
    show = lambda v: "" if v is None else f"{v:,.1f}" if isinstance(v, float) else html.escape(str(v))
    head = "".join(f"<th>{html.escape(k)}</th>" for k in rows[0])
    return f"<table><tr>{head}</tr>" + "".join("<tr>" + "".join(f"<td>{show(v)}</td>" for v in r.values()) + "</tr>" for r in rows) + "</table>"


def report_html(comparison: DataFrame, steps: DataFrame, simulated: DataFrame, summary: DataFrame, site: int, method: str = "") -> str:
    """One site's report as a page that needs nothing else. Only this site's rows are collected: its steps and stores."""
    own = lambda df: df.where(F.col("site") == site)
    row = next((r.asDict() for r in own(comparison).collect()), None)
    flow = own(steps).select("time_min", "baseline_ls", "outflow_ls", "runoff_m3").orderBy("time_min").collect()
    stores = own(summary).orderBy("name").collect()
    fills: dict[str, list[tuple[float, float]]] = {}
    for r in own(simulated).select("name", "time_min", "fill_pct").orderBy("name", "time_min").collect():
        fills.setdefault(r["name"], []).append((r["time_min"] / 60, r["fill_pct"]))
    spills = {s["name"]: s["first_overflow_hr"] for s in stores if s["first_overflow_hr"]}
    lines = {"before": [(r["time_min"] / 60, r["baseline_ls"]) for r in flow], "after": [(r["time_min"] / 60, r["outflow_ls"]) for r in flow]} if flow else {}
    cut = {k: v for k, v in (row or {}).items() if k in ("cut_m3", "fill_m3", "net_m3")}
    sections = [
        ("Summary", f"<p>{html.escape(headline(row))}</p>" if row else "<p>no comparison</p>"), ("Before and after", _table([row] if row else [])), ("Outflow", chart(lines, "Outflow in L/s")),
        ("Stores", _table([s.asDict() for s in stores])), ("Fill of the stores", chart(fills, "Fill in %", spills, 100.0)), ("Cut and fill", _table([cut] if cut else [])), ("Method", f"<p>{html.escape(method)}</p>"),
    ]
    style = "body{font:14px sans-serif;max-width:60em;margin:2em auto}table{border-collapse:collapse}td,th{border:1px solid #bbb;padding:2px 8px}"
    body = "".join(f"<h2>{name}</h2>{text}" for name, text in sections)
    return f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>Storm report, site {site}</title><style>{style}</style></head><body><h1>Storm report, site {site}</h1>{body}</body></html>'
