"""Names, units and texts for what the analyses return, as columns. Halves are rounded up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rillwork.functions import hydro as H

DIRECTIONS = {
    "d8": "D8 flow direction (codes 1=E 2=SE 4=S 8=SW 16=W 32=NW 64=N 128=NE)",
    "dinf": "D-infinity flow direction (angle in radians, counter-clockwise from east)",
}


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def fixed(x, digits: int = 1, thousands: bool = True) -> Column:
    """A number with so many digits, null for null; the crumb lifts halves that binary numbers hold a little below."""
    return F.when(_c(x).isNotNull(), F.format_string(f"%{',' if thousands else ''}.{digits}f", _c(x).cast("double") + 1e-9))


def minutes(time_min) -> Column:
    return F.concat(_c(time_min).cast("string"), F.lit(" min"))


def hours(time_min) -> Column:
    return F.round(_c(time_min) / 60.0, 2)


def area_text(m2) -> Column:
    """Hectares from a tenth of one on, with square metres behind them."""
    a = _c(m2)
    metres = F.concat(fixed(a, 0), F.lit(" m²"))
    return F.when(a >= 1000, F.concat(fixed(a / 10000, 2, False), F.lit(" ha  ("), metres, F.lit(")"))).otherwise(metres)


def crs_label(epsg, text=None) -> Column:
    return F.coalesce(F.concat(F.lit("EPSG:"), _c(epsg).cast("string")), _c(text) if text is not None else F.lit(None), F.lit("unknown CRS"))


def direction_text(routing) -> Column:
    return F.when(_c(routing) == "dinf", DIRECTIONS["dinf"]).otherwise(DIRECTIONS["d8"])


def contour_label(rank, elevation, peak_acc, cell_m2=None, runoff_mm=None) -> Column:
    """With the cell's area in hectares, and with a runoff depth the inflow too; in cells otherwise."""
    head = F.concat(F.coalesce(F.concat(F.lit("#"), _c(rank).cast("string"), F.lit(" ")), F.lit("")), F.lit("Elev "), fixed(elevation, 1, False), F.lit(" m — "))
    if cell_m2 is None:
        return F.concat(head, F.lit("peak acc "), fixed(peak_acc, 0), F.lit(" cells"))
    out = F.concat(head, fixed(_c(peak_acc) * cell_m2 / 10000), F.lit(" ha upslope"))
    return out if runoff_mm is None else F.concat(out, F.lit(" — "), fixed(_c(peak_acc) * cell_m2 * runoff_mm / 1000, 0), F.lit(" m³ inflow"))


def segment_label(rank, elevation, ha, inflow_m3, required_m, length_m) -> Column:
    head = F.concat(F.lit("#"), _c(rank).cast("string"), F.lit("  Elev "), fixed(elevation, 1, False), F.lit(" m — "), fixed(ha), F.lit(" ha upslope — "))
    sized = F.concat(fixed(inflow_m3, 0), F.lit(" m³ inflow — "), fixed(required_m, 0, False), F.lit(" m swale required"))
    return F.concat(head, F.when(F.coalesce(_c(inflow_m3), F.lit(0.0)) != 0, sized).otherwise(F.concat(fixed(length_m, 0, False), F.lit(" m long"))))


def exit_label(rank, volume_m3, flow_ls) -> Column:
    return F.concat(F.lit("Exit "), _c(rank).cast("string"), F.lit(": "), fixed(volume_m3, 0), F.lit(" m³ over event | avg "), fixed(flow_ls), F.lit(" L/s"))


def catchment_label(rank, m2) -> Column:
    return F.concat(F.lit("Catchment "), _c(rank).cast("string"), F.lit(": "), fixed(_c(m2) / 10000, 1, False), F.lit(" ha ("), fixed(m2), F.lit(" m²)"))


def keypoint_label(rank, elevation, ha, slope_deg) -> Column:
    return F.concat(F.lit("Keypoint "), _c(rank).cast("string"), F.lit(" — "), fixed(elevation, 0, False), F.lit(" m, "), fixed(ha, 0, False), F.lit(" ha upslope, "), fixed(slope_deg, 1, False), F.lit("° slope"))


def pond_label(rank, ha, width_m) -> Column:
    return F.concat(F.lit("Pond site "), _c(rank).cast("string"), F.lit(" — "), fixed(ha, 0, False), F.lit(" ha catchment, ~"), fixed(width_m, 0, False), F.lit(" m dam wall"))


def ridge_label(length_m) -> Column:
    return F.concat(F.lit("Ridge — "), fixed(length_m, 0, False), F.lit(" m"))


def work_label(name, kind, capacity_m3, crest, depth, width, gradient_pct, enabled) -> Column:
    """What an earthwork is: a dam's crest, a drain's fall and discharge, what any other holds; and whether it is off."""
    n, k = _c(name), _c(kind)
    dam = F.concat(n, F.lit(" (Dam) — crest "), F.coalesce(F.concat(fixed(crest, 1, False), F.lit(" m")), F.lit("?")))
    drain = F.concat(n, F.lit(" (Diversion) — "), fixed(gradient_pct, 1, False), F.lit("% | Q="), fixed(H.manning_m3s(depth, width, gradient_pct), 3, False), F.lit(" m³/s"))
    other = F.concat(n, F.lit(" ("), F.initcap(k), F.lit(") — "), fixed(capacity_m3, 1, False), F.lit(" m³"))
    return F.concat(F.when(k == "dam", dam).when(k == "diversion", drain).otherwise(other), F.when(_c(enabled), "").otherwise(" [OFF]"))


def capture_text(fraction) -> Column:
    f = _c(fraction)
    text = F.concat(fixed(f * 100, 0, False), F.lit("% of design-storm inflow"))
    return F.when(f < 0, "").when(f <= 1, F.concat(text, F.lit(" captured"))).otherwise(F.concat(text, F.lit(" — depression overflows")))


def slope_hint(deg) -> Column:
    hint = H.draw_hint(deg)
    return F.when(hint == "", "").otherwise(F.concat(F.lit("Slope: "), fixed(deg, 1, False), F.lit("°  "), F.initcap(hint)))


def fill_hue(pct) -> Column:
    """From green (120) when empty to red (0) when full."""
    return 120 - 1.2 * F.greatest(F.lit(0.0), F.least(F.lit(100.0), _c(pct)))


def soil_lookup(soil, table: dict, otherwise: float) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, float(v))]), _c(soil)), F.lit(float(otherwise)))


def cells_of_ha(ha, cell_m2: float, least: int = 0) -> Column:
    """A threshold in cells from one in hectares; 1000 where a cell has no area."""
    return F.lit(1000) if cell_m2 <= 0 else F.greatest(F.lit(least), F.floor(_c(ha) * 10000.0 / cell_m2).cast("int"))
