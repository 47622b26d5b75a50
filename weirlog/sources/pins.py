"""Stored pins: views with their filters that are laid over a timeline, by name, as links in a JSON document."""

from __future__ import annotations

import json
import os
import tempfile
from dataclasses import replace

from pyspark.sql import DataFrame

from weirlog.model import Filter, view
from weirlog.operators import aggregates


class PinSet:
    """Up to aggregates.PINS pins in the order in which they were set. A pin keeps no times: those of the current filter count."""

    def __init__(self, path: str | None = None):
        self.path, self.pins = path, {}
        if path and os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                self.pins = {name: (p["view"], Filter.from_query(p["filter"])) for name, p in json.load(f)["pins"].items()}

    def put(self, name: str, view_name: str, flt: Filter) -> None:
        view(view_name)
        if name not in self.pins and len(self.pins) >= aggregates.PINS:
            raise ValueError(f"no more than {aggregates.PINS} pins")
        self.pins[name] = (view_name, replace(flt, time_from=None, time_to=None))

    def delete(self, name: str) -> bool:
        return self.pins.pop(name, None) is not None

    def save(self) -> None:
        if not self.path:
            return
        folder = os.path.dirname(os.path.abspath(self.path))
        os.makedirs(folder, exist_ok=True)
        fd, beside = tempfile.mkstemp(dir=folder)
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            json.dump({"pins": {n: {"view": v, "filter": f.to_query()} for n, (v, f) in self.pins.items()}}, f, indent=2)
        os.replace(beside, self.path)

    def overlay(self, rows: DataFrame, main: DataFrame, flt: Filter, width: int) -> DataFrame:
        """A timeline of buckets of `width` with the hits of each pin beside it, within the time of the current filter."""
        return aggregates.overlay(main, aggregates.pinned(rows, self.pins, flt, width))
