"""Box formats as pairs of column functions on arrays of numbers; every conversion goes through the normalised quad."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import geometry as g


@dataclass(frozen=True)
class Format:
    """keeps: what of a quad a format holds (`quad`, `rectangle` or `envelope`). pixels: it needs the image's size."""

    keeps: str
    pixels: bool
    to_quad: Callable[[Column, Column, Column], Column]
    from_quad: Callable[[Column, Column, Column], Column]


def _at(v: Column, n: int) -> list[Column]:
    return [F.get(v, F.lit(i)) for i in range(n)]


def _vertices(v: Column) -> Column:
    p = _at(v, 8)
    return g.quad([(p[2 * i], p[2 * i + 1]) for i in range(4)])


def _numbers(q: Column) -> Column:
    return F.array(*[c for i in range(4) for c in g.xy(q, i)])


def _corners(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return g.quad([(x0, y0), (x1, y0), (x1, y1), (x0, y1)])


def _centred(v: Column) -> Column:
    cx, cy, w, h = _at(v, 4)
    return _corners(cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2)


def _sided(v: Column) -> Column:
    x, y, w, h = _at(v, 4)
    return _corners(x, y, x + w, y + h)


def _to_centred(q: Column) -> Column:
    x0, y0, x1, y1 = g.bounds(q)
    return F.array((x0 + x1) / 2, (y0 + y1) / 2, x1 - x0, y1 - y0)


def _to_sided(q: Column) -> Column:
    x0, y0, x1, y1 = g.bounds(q)
    return F.array(x0, y0, x1 - x0, y1 - y0)


def rotated_box(px: Column) -> Column:
    """[cx, cy, w, h, angle in 0 to pi] of a pixel quad that is a rectangle; others are an error."""

    def box(c: Column) -> Column:
        e, (cx, cy), ((x0, y0), (x1, y1)) = g.edge_lengths(c, F.lit(1.0)), g.centroid(c), (g.xy(c, 0), g.xy(c, 1))
        a = F.atan2(y1 - y0, x1 - x0)
        return F.array(cx, cy, F.get(e, F.lit(0)), F.get(e, F.lit(1)), F.when(a < 0, a + F.pi()).otherwise(a))

    return F.when(g.is_rectangle(px), g.let(g.canonical(px, F.lit(1.0)), box)).otherwise(F.raise_error(F.lit("a quad is no rectangle")).cast("array<double>"))


FORMATS: dict[str, Format] = {
    "obb_yolo": Format("quad", False, lambda v, w, h: g.snapped(_vertices(v)), lambda q, w, h: _numbers(q)),
    "dota": Format("quad", True, lambda v, w, h: g.to_norm(_vertices(v), w, h), lambda q, w, h: g.let(g.to_px(q, w, h), _numbers)),
    "voc_xml": Format("rectangle", True, lambda v, w, h: g.to_norm(g.box_quad(*_at(v, 5)), w, h), lambda q, w, h: g.let(g.to_px(q, w, h), rotated_box)),
    "bbox_yolo": Format("envelope", False, lambda v, w, h: g.snapped(_centred(v)), lambda q, w, h: _to_centred(q)),
    "coco": Format("envelope", True, lambda v, w, h: g.to_norm(_sided(v), w, h), lambda q, w, h: g.let(g.to_px(q, w, h), _to_sided)),
}


def known(name: str) -> Format:
    if name not in FORMATS:
        raise ValueError(f"unknown format {name!r}, not one of {sorted(FORMATS)}")
    return FORMATS[name]


def convert(value: Column, source: str, target: str, width: Column | None = None, height: Column | None = None) -> Column:
    """A box (array of numbers) in another format. Formats in pixels need the image's size."""
    a, b = known(source), known(target)
    if (a.pixels or b.pixels) and (width is None or height is None):
        raise ValueError(f"{source} to {target} needs the image's size")
    return g.let(a.to_quad(value, width, height), lambda q: b.from_quad(q, width, height))
