"""The aggregate families: what a pane keeps, how panes merge, what comes out.

Each family is a monoid over columns: partial() makes a pane's state from
measurement rows, over() gives the state of a window frame of pane states or of rows, merge() joins two states,
finish() makes the value. A value that is missing is null; NaN counts as missing everywhere
but in sums and averages.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

State = dict[str, Column]


def real(v: Column) -> Column:
    """v, or null for NaN."""
    return F.when(~F.isnan(v), v)


def nearest_rank(values: Column, q: float) -> Column:
    """The value at rank round(q * (n - 1)), halves up, of an array; null if it is empty."""
    s = F.sort_array(values)
    q = min(1.0, max(0.0, q))
    at = F.floor(F.lit(q) * (F.size(s) - 1) + F.lit(0.5)).cast("int")
    return F.when(F.size(s) > 0, F.element_at(s, at + 1))


@dataclass(frozen=True)
class Family:
    """names are the state's columns. rows: columns of a measurement row, as a state of one row."""

    kind: str
    param: float | None = None

    @property
    def names(self) -> tuple[str, ...]:
        return {"sum": ("s",), "count": ("n",), "avg": ("s", "n"), "min": ("v",), "max": ("v",), "quantile": ("vs",), "topk": ("v",), "distinct": ("items",)}[self.kind]

    def _fold(self, value: Column, item: Column) -> State:
        """Aggregate expressions over measurement rows."""
        v = real(value)
        match self.kind:
            case "sum":
                return {"s": F.sum(F.coalesce(value, F.lit(0.0)))}
            case "count":
                return {"n": F.count(F.lit(1))}
            case "avg":
                return {"s": F.sum(value), "n": F.count(value)}
            case "min":
                return {"v": F.min(v)}
            case "max":
                return {"v": F.max(v)}
            case "quantile":
                return {"vs": F.collect_list(v)}
            case "topk":
                return {"v": F.max(F.when(item.isNotNull(), v)) if (self.param or 0) >= 1 else F.max(F.lit(None).cast("double"))}
            case "distinct":
                return {"items": F.collect_set(item)}
        raise ValueError(self.kind)

    def partial(self, value: Column, item: Column, prefix: str = "") -> list[Column]:
        return [c.alias(prefix + n) for n, c in self._fold(value, item).items()]

    def prefix(self, value: Column, item: Column, frame: WindowSpec) -> State:
        """The state of the rows of a frame."""
        return {n: c.over(frame) for n, c in self._fold(value, item).items()}

    def over(self, state: State, frame: WindowSpec) -> State:
        """The merge of the pane states of a frame; nulls or empty arrays if there is none."""
        match self.kind:
            case "sum" | "count" | "avg":
                return {n: F.sum(c).over(frame) for n, c in state.items()}
            case "min":
                return {"v": F.min(state["v"]).over(frame)}
            case "max" | "topk":
                return {"v": F.max(state["v"]).over(frame)}
            case "quantile":
                return {"vs": F.flatten(F.collect_list(state["vs"]).over(frame))}
            case _:
                return {"items": F.array_distinct(F.flatten(F.collect_list(state["items"]).over(frame)))}

    def totals(self, state: State) -> State:
        """The merge of pane states as aggregate expressions, for a groupBy."""
        match self.kind:
            case "sum" | "count" | "avg":
                return {n: F.sum(c) for n, c in state.items()}
            case "min":
                return {"v": F.min(state["v"])}
            case "max" | "topk":
                return {"v": F.max(state["v"])}
            case "quantile":
                return {"vs": F.flatten(F.collect_list(state["vs"]))}
            case _:
                return {"items": F.array_distinct(F.flatten(F.collect_list(state["items"])))}

    def merge(self, a: State, b: State) -> State:
        match self.kind:
            case "sum" | "count" | "avg":
                return {n: F.coalesce(a[n], F.lit(0)) + F.coalesce(b[n], F.lit(0)) for n in a}
            case "min":
                return {"v": F.least(a["v"], b["v"])}
            case "max" | "topk":
                return {"v": F.greatest(a["v"], b["v"])}
            case "quantile":
                return {"vs": F.concat(F.coalesce(a["vs"], F.array().cast("array<double>")), F.coalesce(b["vs"], F.array().cast("array<double>")))}
            case _:
                return {"items": F.array_union(F.coalesce(a["items"], F.array().cast("array<string>")), F.coalesce(b["items"], F.array().cast("array<string>")))}

    def finish(self, state: State) -> Column:
        match self.kind:
            case "sum":
                return state["s"].cast("double")
            case "count":
                return state["n"].cast("double")
            case "avg":
                return F.when(state["n"] > 0, state["s"] / state["n"])
            case "quantile":
                return nearest_rank(state["vs"], 0.5 if self.param is None else self.param)
            case "distinct":
                return F.size(state["items"]).cast("double")
        return state["v"]
