"""Definitions and control: viewers, dashboards, alerts, incidents, channels, budgets, keys, settings.

Small data held on the driver and saved as one Parquet table (kind, id, body); queries stay in ``operators``.
"""

from __future__ import annotations

import hashlib
import json
import re
import secrets
import urllib.error
import urllib.request
import uuid
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import SparkSession

from .operators import insight
from .operators.viewers import SIGNAL_BITS, check_chart, check_group_by, compile_viewer

NAME_LENGTH = {"viewer": 80, "dashboard": 80, "alert": 80, "channel": 80, "slo": 120}
ORDER = {"alert": ("name", False), "slo": ("name", False), "channel": ("name", False), "dashboard": ("created_at", False), "key": ("created_at", False), "incident": ("opened_at", True), "viewer": ("name", False)}
COLUMNS = (1, 4, 2)  # least, most, default
LEAST_ALERT_INTERVAL_MS = 1_000
SEVERITIES = ("info", "warning", "critical")
INCIDENT_STATES = ("open", "acknowledged", "resolved")
WEBHOOK_SECONDS = 10


class CatalogError(ValueError):
    def __init__(self, status: int, detail: str):
        super().__init__(detail)
        self.status = status


def clean_name(kind: str, name: str) -> str:
    name = (name or "").strip()
    if not 1 <= len(name) <= NAME_LENGTH[kind]:
        raise CatalogError(400, f"a {kind}'s name has 1 to {NAME_LENGTH[kind]} characters")
    return name


def layout(panels: list[dict], columns: int = COLUMNS[2]) -> dict:
    """A dashboard's layout: panels by position, spans of 1 where none are given."""
    if not COLUMNS[0] <= columns <= COLUMNS[1]:
        raise CatalogError(400, "columns out of range")
    made = [{"viewer_id": p["viewer_id"], "position": i, "col_span": p.get("col_span", 1), "row_span": p.get("row_span", 1)} for i, p in enumerate(panels)]
    return {"columns": columns, "panels": made}


def panels_of(body: dict) -> list[dict]:
    """Panels that have a viewer and a position, by position."""
    good = [p for p in body.get("panels", ()) if isinstance(p.get("viewer_id"), str) and isinstance(p.get("position"), int)]
    return sorted(good, key=lambda p: p["position"])


def replace_viewers(body: dict, viewer_ids: list[str]) -> dict:
    """New viewers of a dashboard; viewers that stay keep their spans."""
    old = {p["viewer_id"]: p for p in panels_of(body)}
    return layout([{"viewer_id": v} | {k: old.get(v, {}).get(k, 1) for k in ("col_span", "row_span")} for v in viewer_ids], body.get("columns", COLUMNS[2]))


def dashboard_lookback(viewers: list[dict]) -> int | None:
    return min((v["lookback_ms"] for v in viewers), default=None)


def advance(old: str, new: str) -> str:
    """An incident goes forward only."""
    if old == new:
        raise CatalogError(409, f"already {new}")
    if INCIDENT_STATES.index(new) < INCIDENT_STATES.index(old):
        raise CatalogError(409, f"no way from {old} to {new}")
    return new


def hash_key(key: str) -> str:
    return hashlib.sha256(key.encode()).hexdigest()


def new_key() -> str:
    return "key_" + secrets.token_hex(32)


def bearer(header: str | None) -> str | None:
    m = re.fullmatch(r"Bearer (\S+)", header or "")
    return m[1] if m else None


# The templates, as (name, signal, chart, look-back in ms, query, columns, rows of its panel).
TEMPLATES = {
    "service-overview": ("Service Overview", [
        ("Request Count", "metrics", "billboard", 300_000, None, 1, 1), ("Error Rate", "metrics", "billboard", 300_000, "error", 1, 1),
        ("Request Latency", "metrics", "line", 900_000, None, 2, 1), ("Recent Traces", "traces", "table", 300_000, None, 2, 1),
    ]),
    "trace-analysis": ("Trace Analysis", [
        ("All Traces", "traces", "table", 900_000, None, 2, 2), ("Error Traces", "traces", "table", 900_000, "error", 1, 1), ("Trace Volume", "metrics", "area", 3_600_000, None, 1, 1),
    ]),
    "log-monitoring": ("Log Monitoring", [
        ("All Logs", "logs", "table", 900_000, None, 2, 1), ("Error Logs", "logs", "table", 900_000, "error", 1, 1), ("Log Volume by Severity", "metrics", "stacked_bar", 3_600_000, None, 1, 1),
    ]),
}


@dataclass
class Catalog:
    """All definitions by kind and id."""

    rows: dict[str, dict[str, dict]] = field(default_factory=dict)

    def get(self, kind: str, key: str) -> dict:
        try:
            return self.rows[kind][key]
        except KeyError:
            raise CatalogError(404, f"no {kind} {key}") from None

    def listed(self, kind: str) -> list[dict]:
        by, newest_first = ORDER[kind]
        return sorted(self.rows.get(kind, {}).values(), key=lambda r: r.get(by) or "", reverse=newest_first)

    def delete(self, kind: str, key: str) -> None:
        self.get(kind, key)
        del self.rows[kind][key]

    def _put(self, kind: str, row: dict) -> dict:
        self.rows.setdefault(kind, {})[row["id"]] = row
        return row

    # viewers

    def create_viewer(self, name: str, signals: list[str], lookback_ms: int, chart: str = "table", **body) -> dict:
        check_chart(chart, signals)
        check_group_by((body.get("aggregation") or {}).get("group_by", []))
        row = {"id": uuid.uuid4().hex, "name": clean_name("viewer", name), "signal_mask": sum(SIGNAL_BITS[s] for s in set(signals)), "lookback_ms": lookback_ms, "refresh_interval_ms": 1_000, "revision": 1, "enabled": True}
        row |= {"slug": f"viewer-{row['id']}", "definition_json": {"chart_type": chart} | {k: v for k, v in body.items() if v is not None}}
        compile_viewer(row)
        return self._put("viewer", row)

    def patch_viewer(self, key: str, **changes) -> str:
        """Applies changes; says whether entries must be matched anew, only aggregated anew, or neither."""
        row = dict(self.get("viewer", key))
        body = dict(row["definition_json"])
        matcher = {"query", "filters", "filter_mode"}
        for k, v in changes.items():
            if k == "name":
                row["name"] = clean_name("viewer", v)
            elif k in matcher | {"chart_type", "aggregation"}:
                body[k] = v
                if v is None:
                    del body[k]
            elif k in ("lookback_ms", "signal_mask", "enabled"):
                row[k] = v
            else:
                raise CatalogError(400, f"unknown field {k}")
        signals = [s for s, bit in SIGNAL_BITS.items() if row["signal_mask"] & bit]
        check_chart(body.get("chart_type", "table"), signals)
        row |= {"definition_json": body, "revision": row["revision"] + 1}
        compile_viewer(row)
        self._put("viewer", row)
        if (matcher | {"lookback_ms", "signal_mask"}) & changes.keys():
            return "rebuild"
        return "recompute" if {"chart_type", "aggregation"} & changes.keys() else "metadata"

    def enabled_viewers(self) -> list[dict]:
        return [v for v in self.listed("viewer") if v["enabled"]]

    def add_defaults(self) -> None:
        """The viewers that a store without definitions starts with."""
        for signal in SIGNAL_BITS:
            row = self.create_viewer(f"All {signal.capitalize()}", [signal], 300_000)
            row["slug"] = f"all-{signal}"

    # dashboards

    def create_dashboard(self, name: str, panels: list[dict], columns: int = COLUMNS[2], created_at: str = "") -> dict:
        for p in panels:
            self.get("viewer", p["viewer_id"])
        key = uuid.uuid4().hex
        return self._put("dashboard", {"id": key, "slug": f"dashboard-{key}", "name": clean_name("dashboard", name), "layout_json": layout(panels, columns), "created_at": created_at})

    def from_template(self, template: str, created_at: str = "") -> dict:
        """A dashboard and its viewers; what was made goes again if one part fails."""
        if template not in TEMPLATES:
            raise CatalogError(404, f"no template {template}")
        name, parts = TEMPLATES[template]
        made: list[dict] = []
        try:
            for n, signal, chart, lookback, query, _, _ in parts:
                made.append(self.create_viewer(n, [signal], lookback, chart, query=query))
            return self.create_dashboard(name, [{"viewer_id": v["id"], "col_span": p[5], "row_span": p[6]} for v, p in zip(made, parts)], created_at=created_at)
        except Exception:
            for v in made:
                self.rows["viewer"].pop(v["id"], None)
            raise

    def export_dashboard(self, key: str) -> dict:
        """Version 1 of the exchange format: one signal a viewer, no aggregation."""
        d = self.get("dashboard", key)
        viewers = []
        for p in panels_of(d["layout_json"]):
            v = self.get("viewer", p["viewer_id"])
            body = v["definition_json"]
            signal = next(s for s, bit in SIGNAL_BITS.items() if v["signal_mask"] & bit)
            viewers.append({"id": v["id"], "name": v["name"], "signal": signal, "chart_type": body.get("chart_type", "table"), "lookback_ms": v["lookback_ms"], "query": body.get("query"), "filters": body.get("filters", []), "filter_mode": body.get("filter_mode", "and")})
        return {"version": 1, "dashboard": {"name": d["name"], "layout": d["layout_json"]}, "viewers": viewers}

    def import_dashboard(self, data: dict, created_at: str = "") -> dict:
        """Makes new viewers and maps the panels to them."""
        if data.get("version") != 1:
            raise CatalogError(400, "unknown version")
        ids = {}
        for v in data["viewers"]:
            ids[v["id"]] = self.create_viewer(v["name"], [v["signal"]], v["lookback_ms"], v.get("chart_type", "table"), query=v.get("query"), filters=v.get("filters") or None, filter_mode=v.get("filter_mode"))["id"]
        old = data["dashboard"]["layout"]
        panels = [p | {"viewer_id": ids[p["viewer_id"]]} for p in panels_of(old) if p["viewer_id"] in ids]
        return self.create_dashboard(data["dashboard"]["name"], panels, old.get("columns", COLUMNS[2]), created_at)

    # alerts, incidents, channels, budgets, keys

    def create_alert(self, name: str, viewer_id: str, op: str, threshold: float, severity: str = "warning", interval_ms: int = 60_000) -> dict:
        self.get("viewer", viewer_id)
        if interval_ms < LEAST_ALERT_INTERVAL_MS:
            raise CatalogError(400, "interval too short")
        if severity not in SEVERITIES:
            raise CatalogError(400, f"unknown severity {severity}")
        insight.breaches(op, 0.0, 0.0)
        return self._put("alert", {"id": uuid.uuid4().hex, "name": clean_name("alert", name), "viewer_id": viewer_id, "op": op, "threshold": float(threshold), "severity": severity, "interval_ms": interval_ms})

    def alerts(self) -> list[insight.Alert]:
        return [insight.Alert(r["id"], r["viewer_id"], r["op"], r["threshold"], r["severity"], r["interval_ms"]) for r in self.listed("alert")]

    def open_incident(self, title: str, severity: str, at: datetime) -> dict:
        return self._put("incident", {"id": uuid.uuid4().hex, "title": title, "severity": severity, "status": "open", "opened_at": at.isoformat(), "acknowledged_at": None, "resolved_at": None})

    def move_incident(self, key: str, status: str, at: datetime) -> dict:
        row = self.get("incident", key)
        row["status"] = advance(row["status"], status)
        row[f"{status}_at"] = row.get(f"{status}_at") or at.isoformat()
        return row

    def create_channel(self, name: str, url: str, headers: dict[str, str] | None = None, enabled: bool = True) -> dict:
        if not re.match(r"https?://", url):
            raise CatalogError(400, "a webhook has an http address")
        return self._put("channel", {"id": uuid.uuid4().hex, "name": clean_name("channel", name), "url": url, "headers": headers or {}, "enabled": enabled})

    def create_slo(self, name: str, viewer_id: str, target_pct: float, window_ms: int, total: dict, success: dict) -> dict:
        self.get("viewer", viewer_id)
        if not 0 < target_pct <= 100 or window_ms <= 0:
            raise CatalogError(400, "target or window out of range")
        for body in (total, success):
            compile_viewer({"signal_mask": 7, "lookback_ms": window_ms, "definition_json": body})
        return self._put("slo", {"id": uuid.uuid4().hex, "name": clean_name("slo", name), "viewer_id": viewer_id, "target_pct": target_pct, "window_ms": window_ms, "total": total, "success": success})

    def slo_budget(self, key: str, entries, now: datetime):
        row = self.get("slo", key)
        total, success = (compile_viewer({"signal_mask": 7, "lookback_ms": row["window_ms"], "definition_json": row[k]}).predicate() for k in ("total", "success"))
        return insight.slo_budget(entries, total, success, row["target_pct"], row["window_ms"], now)

    def create_key(self, name: str, created_at: str = "") -> str:
        """The key itself, shown once; only its hash is kept."""
        key = new_key()
        self._put("key", {"id": uuid.uuid4().hex, "name": name, "hash": hash_key(key), "created_at": created_at})
        return key

    def authorized(self, header: str | None) -> bool:
        """Without keys all are let in; else a bearer key that is known."""
        known = self.rows.get("key", {})
        key = bearer(header)
        return not known or key is not None and any(secrets.compare_digest(r["hash"], hash_key(key)) for r in known.values())

    # storage

    def save(self, spark: SparkSession, path: str) -> None:
        flat = [(k, i, json.dumps(r)) for k, rows in self.rows.items() for i, r in rows.items()]
        spark.createDataFrame(flat, "kind string, id string, body string").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Catalog:
        out = cls()
        for r in spark.read.parquet(path).collect():
            out.rows.setdefault(r.kind, {})[r.id] = json.loads(r.body)
        return out


def send_webhook(channel: dict, payload: dict, post=None) -> int:
    """Posts JSON to a channel; an answer outside 200-299 is an error."""
    body = json.dumps(payload).encode()
    request = urllib.request.Request(channel["url"], body, {"Content-Type": "application/json"} | channel["headers"], method="POST")
    try:
        with (post or urllib.request.urlopen)(request, timeout=WEBHOOK_SECONDS) as answer:
            return answer.status
    except urllib.error.HTTPError as e:
        raise CatalogError(502, f"webhook answered {e.code}") from e


# Names and defaults of the settings.
SETTINGS = {"HTTP_PORT": 8080, "VIEWER_RUNTIME_POLL_MS": 1_000, "STREAM_MAX_LEN": 100_000, "STANDALONE": True}


def settings(env: dict[str, str]) -> dict:
    """Settings from text; a bad value fails at once."""
    out = dict(SETTINGS)
    for name in ("HTTP_PORT", "VIEWER_RUNTIME_POLL_MS", "STREAM_MAX_LEN"):
        raw = env.get(name, env.get("PORT") if name == "HTTP_PORT" else None)
        if raw is not None:
            if not raw.isdigit() or not (1 if name != "HTTP_PORT" else 0) <= int(raw) <= (65_535 if name == "HTTP_PORT" else 1 << 62):
                raise CatalogError(400, f"{name} is not valid: {raw!r}")
            out[name] = int(raw)
    if (raw := env.get("STANDALONE")) is not None:
        if raw.lower() not in ("true", "false", "1", "0"):
            raise CatalogError(400, f"STANDALONE is not valid: {raw!r}")
        out["STANDALONE"] = raw.lower() in ("true", "1")
    return out
