"""filter and route."""

from __future__ import annotations

from pyspark.sql import functions as F

from weir.operators.base import PASS, Result, Stage
from weir.plans.frames import Frame


class Filter(Stage):
    """Keeps, or drops, the records for which a condition holds. A record whose text is too long to search is dropped either way."""

    required, optional = ("condition", "action"), ("limits", "on_redos_risk")

    def __init__(self, node: str, params: dict):
        super().__init__(node, params)
        self.keep = self.choice(params["action"], "keep", "drop") == "keep"
        self.when = self.condition(params["condition"], params)

    def apply(self, frame: Frame) -> Result:
        over = self.when.too_long(frame)
        holds = self.when.holds(frame, False)
        kept = self.when.holds(frame) if self.keep else ~holds
        gone = ~holds if self.keep else holds
        if over is None:
            return Result({PASS: frame.filter(kept)}, {"filter": frame.filter(gone).df})
        return Result({PASS: frame.filter(~over & kept)}, {"regex_limit": frame.filter(over).df, "filter": frame.filter(~over & gone).df})


class Route(Stage):
    """Sends each record to the first label whose condition holds, else to the default."""

    required, optional = ("routes", "default"), ("limits", "on_redos_risk")

    def __init__(self, node: str, params: dict):
        super().__init__(node, params)
        if not self.mapping(params["routes"], "`routes`"):
            raise self.error("empty_list", "`routes` has no label")
        if "drop" in params["routes"]:
            raise self.error("reserved_label", "`drop` is what `default` says to drop records; no label is called that")
        self.default = self.text(params["default"], "`default`")
        self.routes = {self.text(label, "a label"): self.condition(text, params) for label, text in params["routes"].items()}

    def apply(self, frame: Frame) -> Result:
        label, over = F.lit(None).cast("string"), F.lit(False)
        for name, when in reversed(self.routes.items()):
            holds = when.holds(frame, False)
            label = F.when(holds, F.lit(name)).otherwise(label)
            long = when.too_long(frame)
            over = F.when(F.lit(False) if long is None else long, True).when(holds, False).otherwise(over)
        searched = any(w.patterns for w in self.routes.values())
        marked = frame.df.withColumn("_label", F.when(over, F.lit("\0")).otherwise(F.coalesce(label, F.lit(self.default))) if searched else F.coalesce(label, F.lit(self.default)))

        def part(name: str) -> Frame:
            return Frame(marked.filter(F.col("_label") == name).drop("_label"))

        outputs = {name: part(name) for name in dict.fromkeys([*self.routes, self.default]) if name != "drop"}
        dropped = ({"route_default_drop": part("drop").df} if self.default == "drop" else {}) | ({"regex_limit": part("\0").df} if searched else {})
        return Result(outputs, dropped)
