"""A static HTML report of the dynamic and the static pool: overview, timeline and panels, without scripts."""

from __future__ import annotations

import html
from datetime import UTC, datetime

from pyspark.sql import DataFrame

from weirlog.functions.labels import human_bytes
from weirlog.model import Filter
from weirlog.plans.dashboard import dashboard

_STYLE = "body{font:14px sans-serif;margin:2em}table{border-collapse:collapse;margin-bottom:1.5em}td,th{padding:2px 8px;text-align:left}.n{text-align:right}.bar{background:#9bd;height:10px}"


def _when(ns: int | None) -> str:
    return "-" if ns is None else datetime.fromtimestamp(ns / 1e9, UTC).strftime("%Y-%m-%d %H:%M:%S UTC")


def tick_format(span_ns: int) -> str:
    """Finer labels for shorter spans."""
    hours = span_ns / 3.6e12
    return "%H:%M:%S" if hours <= 2 else "%H:%M" if hours <= 36 else "%d %b %Hh" if hours <= 240 else "%d %b" if hours <= 17_520 else "%b %Y"


def _table(title: str, rows: list[dict]) -> str:
    most = max((r["hits"] for r in rows), default=0) or 1
    lines = [
        f"<tr><td>{html.escape(str(r['key'])) or '(none)'}</td><td class=n>{r['hits']:,}</td><td class=n>{r['visitors']:,}</td><td class=n>{human_bytes(r['bytes'])}</td>"
        f"<td style='width:120px'><div class=bar style='width:{100 * r['hits'] // most}%'></div></td></tr>" for r in rows
    ]
    return f"<h3>{html.escape(title)}</h3><table><tr><th>Value<th>Hits<th>Visitors<th>Size<th></tr>{''.join(lines)}</table>"


def _part(title: str, found: dict) -> str:
    o, line = found.get("overview") or {}, found.get("timeline") or []
    most = max((b["hits"] for b in line), default=0) or 1
    form = tick_format(line[-1]["bucket_start"] - line[0]["bucket_start"]) if line else "%H:%M"
    bars = "".join(f"<tr><td>{datetime.fromtimestamp(b['bucket_start'] / 1e9, UTC).strftime(form)}<td class=n>{b['hits']:,}<td style='width:300px'><div class=bar style='width:{100 * b['hits'] // most}%'></div></tr>" for b in line)
    head = f"<p>{o.get('hits', 0):,} hits, {o.get('visitors', 0):,} visitors, {human_bytes(o.get('bytes', 0))}; {_when(o.get('first_ts'))} to {_when(o.get('last_ts'))}</p>"
    errors = "".join(f"<p>{html.escape(k)}: {html.escape(v[:200])}</p>" for k, v in found["errors"].items())
    return f"<h2>{title}</h2>{head}<table>{bars}</table>{''.join(_table(k, v) for k, v in found['panels'].items())}{errors}"


def render(rows: DataFrame, inputs: list[str], flt: Filter | None = None, top: int = 10, static: bool = True, now: int | None = None) -> str:
    """Each pool's figures are gathered as a dashboard's are: a few hundred rows."""
    parts = [_part(pool.capitalize(), dashboard(rows, pool, flt, top, now=now)) for pool in (("dynamic", "static") if static else ("dynamic",))]
    return f"<!doctype html><meta charset=utf-8><title>Access report</title><style>{_STYLE}</style><h1>Access report</h1><p>{html.escape(', '.join(inputs))}</p>{''.join(parts)}"
