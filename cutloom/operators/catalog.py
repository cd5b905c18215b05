"""Effect kinds, models and edit history: what can be registered, and what a project remembers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Param:
    name: str
    label: str
    low: float = 0.0
    high: float = 1.0
    default: float | None = None

    @property
    def start(self) -> float:
        return self.low if self.default is None else self.default


@dataclass(frozen=True)
class Kind:
    """An effect: its parameters and a function from a value column and its parameters to a column."""

    name: str
    label: str
    params: tuple[Param, ...]
    apply: Callable[..., Column]
    description: str = ""
    taps: tuple[tuple[int, int], ...] = ()  # of a kind that looks at neighbours

    @property
    def keys(self) -> list[str]:
        """Names under which its parameters can be animated."""
        return [self.name] if len(self.params) == 1 else [f"{self.name}_{p.name}" for p in self.params]


@dataclass
class Registry:
    """Kinds by name, in order of first registration; a name that comes again replaces its kind in place."""

    kinds: dict[str, Kind] = field(default_factory=dict)
    version: int = 0

    def register(self, kind: Kind) -> Kind:
        self.kinds[kind.name] = kind
        self.version += 1
        return kind

    def expression(self, name: str, sql: str, label: str = "", params: tuple[Param, ...] = ()) -> Kind:
        """A kind from a SQL expression over the columns ``value`` and its parameters' names; no other code is taken."""
        return self.register(Kind(name, label or name, params, lambda **_: F.expr(sql)))

    def apply(self, rows: DataFrame, name: str, **given: float) -> DataFrame:
        """``rows`` with ``value`` as the kind makes it; parameters are given, columns of the rows, or their defaults."""
        kind = self.kinds[name]
        out = rows
        for p in kind.params:
            if p.name in given or p.name not in rows.columns:
                out = out.withColumn(p.name, F.lit(float(given.get(p.name, p.start))))
        return out.withColumn("value", kind.apply(value=F.col("value"), **{p.name: F.col(p.name) for p in kind.params})).select(*rows.columns)

    def stencil(self, name: str, taps: tuple[tuple[int, int], ...], apply: Callable[..., Column], label: str = "", params: tuple[Param, ...] = ()) -> Kind:
        """A kind over neighbours: ``apply(at, **params)`` makes a pixel from ``at(dx, dy)``, the value that far from it, one of ``taps``; beyond the edge the edge pixel repeats."""
        return self.register(Kind(name, label or name, params, apply, taps=taps))

    def apply_stencil(self, pixels: DataFrame, name: str, width: int, height: int, **given: float) -> DataFrame:
        """``pixels`` (frame, x, y, value) as a stencil kind makes them: each pixel is sent to those that look at it; one grouped pass."""
        kind = self.kinds[name]
        near = F.array(*(F.struct(F.lit(i).alias("tap"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for i, (dx, dy) in enumerate(kind.taps)))
        want = pixels.select("frame", "x", "y", F.explode(near).alias("t"))
        inside = lambda c, d, n: F.least(F.greatest(F.col(c) + F.col(d), F.lit(0)), F.lit(n - 1)).cast("long")
        want = want.select("frame", "x", "y", "t.tap", inside("x", "t.dx", width).alias("px"), inside("y", "t.dy", height).alias("py"))
        source = pixels.select("frame", F.col("x").cast("long").alias("px"), F.col("y").cast("long").alias("py"), F.col("value").alias("_v"))
        hit = want.join(source, ["frame", "px", "py"]).groupBy("frame", "x", "y").agg(*(F.max(F.when(F.col("tap") == i, F.col("_v"))).alias(f"_t{i}") for i in range(len(kind.taps))))
        where = {tap: F.col(f"_t{i}") for i, tap in enumerate(kind.taps)}
        settings = {p.name: F.lit(float(given.get(p.name, p.start))) for p in kind.params}
        return hit.select("frame", "x", "y", kind.apply(lambda dx, dy: where[dx, dy], **settings).alias("value"))

    def rows(self, spark: SparkSession) -> DataFrame:
        """The catalog as a table, a row a parameter."""
        flat = [(k.name, k.label, i, p.name, float(p.low), float(p.high), float(p.start)) for k in self.kinds.values() for i, p in enumerate(k.params)]
        return spark.createDataFrame(flat, "kind string, label string, pos int, param string, low double, high double, start double")


@dataclass(frozen=True)
class OverlayKind:
    """What can be laid over a picture: parameters that can be animated, and ``draw(state)``, a column of drawing instructions from the column of an overlay's state."""

    name: str
    label: str
    params: tuple[Param, ...]
    draw: Callable[[Column], Column]


@dataclass
class Overlays:
    """Overlay kinds by name, in order of first registration; a name that comes again replaces its kind in place."""

    kinds: dict[str, OverlayKind] = field(default_factory=dict)
    version: int = 0

    def register(self, name: str, label: str, params: tuple[Param, ...], draw: Callable[[Column], Column]) -> OverlayKind:
        self.kinds[name] = OverlayKind(name, label, params, draw)
        self.version += 1
        return self.kinds[name]

    def drawn(self, states: DataFrame) -> DataFrame:
        """``states`` (kind, state: a map of text) with ``drawing``; parameters that a state lacks have their defaults, a kind that is not registered is an error of that row.

        All kinds are one expression, so overlays of any kinds go through in one pass.
        """
        out = F.raise_error(F.concat(F.lit("no overlay kind "), F.coalesce("kind", F.lit("(none)"))))
        for kind in reversed(self.kinds.values()):
            defaults = F.create_map(*(x for p in kind.params for x in (F.lit(p.name), F.lit(str(float(p.start)))))) if kind.params else F.create_map().cast("map<string,string>")
            given = F.coalesce("state", F.create_map().cast("map<string,string>"))
            missing = F.map_filter(defaults, lambda k, v: ~F.map_contains_key(given, k))  # noqa: B023
            out = F.when(F.col("kind") == kind.name, kind.draw(F.map_concat(given, missing))).otherwise(out)
        return states.withColumn("drawing", out)


MODELS = ("matte", "restore", "depth", "look", "transcribe", "interpolate", "speak")
INERT = ("restore", "interpolate")


@dataclass
class Models:
    """Where a project's own models plug in: a function of an iterator of pandas frames, run by mapInPandas.

    Without a model, restoring and interpolating leave rows as they are; everything else is an error.
    """

    found: dict[str, tuple[Callable, str]] = field(default_factory=dict)

    def register(self, kind: str, run: Callable, schema: str) -> None:
        if kind not in MODELS:
            raise ValueError(f"no model kind {kind!r}; there are {', '.join(MODELS)}")
        self.found[kind] = run, schema

    def run(self, kind: str, rows: DataFrame) -> DataFrame:
        if kind not in self.found:
            if kind in INERT:
                return rows
            raise LookupError(f"no {kind} model is registered")
        return rows.mapInPandas(*self.found[kind])


@dataclass
class History:
    """Versions of a document (a dict of DataFrames, which are never changed): undo, redo, 100 steps deep."""

    now: dict[str, DataFrame]
    depth: int = 100
    past: list[dict[str, DataFrame]] = field(default_factory=list)
    future: list[dict[str, DataFrame]] = field(default_factory=list)
    edits: int = 0

    def edit(self, **tables: DataFrame) -> None:
        self.past = [*self.past, self.now][-self.depth :]
        self.future, self.now, self.edits = [], self.now | tables, self.edits + 1

    def undo(self) -> bool:
        if not self.past:
            return False
        self.future.append(self.now)
        self.now = self.past.pop()
        return True

    def redo(self) -> bool:
        if not self.future:
            return False
        self.past.append(self.now)
        self.now = self.future.pop()
        return True


def builtin() -> Registry:
    """The pointwise kinds that have their arithmetic here."""
    from . import pixels as P

    r = Registry()
    one = lambda name, label, apply, *params: r.register(Kind(name, label, params, apply))
    one("opacity", "Opacity", lambda value, alpha: value * alpha, Param("alpha", "Opacity", 0, 1, 1))
    one("invert", "Invert", lambda value, amount: value + (1 - 2 * value) * amount, Param("amount", "Amount", 0, 1, 1))
    one("levels", "Levels", lambda value, low, high: ((value - low) / (high - low)), Param("low", "Black", 0, 1, 0), Param("high", "White", 0, 1, 1))
    one("quantise", "Quantise", lambda value: P.quantise(value))
    return r


def with_stencils() -> Registry:
    """``builtin`` and the kinds that look at neighbours."""
    r = builtin()
    corners = tuple((dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1))
    r.stencil("emboss", ((1, 1), (-1, -1)), lambda at, strength: 0.5 + strength * (at(1, 1) - at(-1, -1)), "Emboss", (Param("strength", "Strength", 1, 6, 2),))
    across = lambda at: at(1, -1) + 2 * at(1, 0) + at(1, 1) - at(-1, -1) - 2 * at(-1, 0) - at(-1, 1)
    down = lambda at: at(-1, 1) + 2 * at(0, 1) + at(1, 1) - at(-1, -1) - 2 * at(0, -1) - at(1, -1)
    r.stencil("edges", corners, lambda at: F.hypot(across(at), down(at)), "Edges")
    return r
