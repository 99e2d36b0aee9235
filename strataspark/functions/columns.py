"""Column functions: null markers, curve types, names, modes, scores and other row-wise rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Markers, tables, words and colours that must equal the conventions of the data.
MISSING = (-999.25, -999.0, -9999.0, 999.25)
NULL_MARKER = -999.25
#: Type, and what tells it: words in the mnemonic; words in mnemonic, unit or description; words in the unit. The first type wins.
TYPE_WORDS = (
    ("GR", ("GR",), ("GAMMA",), ()),
    ("RHOB", ("RHOB",), ("DENSITY", "RHO B"), ()),
    ("NPHI", ("NPHI",), ("NEUT", "POROSITY"), ()),
    ("DT", ("DT", "DTC"), ("SONIC",), ()),
    ("CALI", ("CALI",), ("CALIPER",), ()),
    ("SP", ("SP",), ("SPONTANEOUS",), ()),
    ("RES", ("RES",), ("RESISTIVITY", "OHMM"), ("OHMM", "OHM-M")),
)
LABEL_WORDS = {
    "GR": ("GR", "GAMMA RAY"),
    "RES": ("RES", "RESISTIVITY", "ILD", "LLD", "LWD RES"),
    "RHOB": ("RHOB", "DENSITY", "RHO B", "BULK DENSITY"),
    "NPHI": ("NPHI", "NEUTRON POROSITY", "NEUT", "PHI N"),
    "PEF": ("PEF", "PHOTOELECTRIC", "PE"),
}
TYPE_DEFAULTS = {
    "GR": ("GR", "API"),
    "RHOB": ("RHOB", "G/CC"),
    "NPHI": ("NPHI", "V/V"),
    "DT": ("DTC", "US/F"),
    "DTC": ("DTC", "US/F"),
    "CALI": ("CALI", "IN"),
    "SP": ("SP", "MV"),
}
PHYSICAL = {"GR": (0.0, 200.0), "RHOB": (1.5, 3.5), "NPHI": (-0.2, 0.6), "DT": (40.0, 200.0), "CALI": (4.0, 20.0), "SP": (-200.0, 100.0)}
ALIASES = {
    "GR": ("GR", "CGR", "SGR", "GAMMA", "GAM", "NGR"),
    "CAL": ("CAL", "CALI", "CALIPER", "HCAL"),
    "BD": ("BD", "RHOB", "DEN", "DENS", "ZDEN"),
    "DPHI": ("DPHI", "NPHI", "TNPH", "NPHI_LS", "PHI"),
    "RILD": ("RILD", "ILD", "LLD", "RT", "RES", "COND"),
    "TEMP": ("TEMP", "TMP", "TEMPERATURE"),
}
METADATA = {
    "COMP": ("comp", "company"),
    "WELL": ("well",),
    "FLD": ("fld", "field"),
    "LOC": ("loc", "location"),
    "CNTY": ("county",),
    "STAT": ("state",),
    "PROV": ("prov", "province"),
    "SRVC": ("srvc", "service", "service_company"),
    "DATE": ("date",),
    "API": ("api",),
    "UWI": ("uwi",),
}
#: Hue bands (0 to 179) by colour; saturation and value reach 80.
HUE_BANDS = {"red": ((0, 10), (170, 179)), "blue": ((90, 140),), "green": ((40, 90),)}


def valid_or_null(v: Column) -> Column:
    """NaN and the missing markers become null."""
    return F.when(F.isnan(v) | v.isin(*MISSING), None).otherwise(v)


def _any_in(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(w) for w in words), F.lit(False))


def curve_type(mnemonic: Column, unit: Column, description: Column) -> Column:
    """The type that mnemonic, unit and description tell, else null."""
    m, u, d = (F.upper(F.coalesce(c, F.lit(""))) for c in (mnemonic, unit, description))
    text = F.concat_ws(" ", m, u, d)
    out = F.lit(None).cast("string")
    for kind, names, words, units in reversed(TYPE_WORDS):
        out = F.when(_any_in(m, names) | _any_in(text, words) | _any_in(u, units), kind).otherwise(out)
    return out


def curve_labels(text: Column) -> Column:
    """Sorted labels whose keywords the text holds."""
    up = F.upper(text)
    return F.array_sort(F.array_compact(F.array(*(F.when(_any_in(up, words), F.lit(k)) for k, words in LABEL_WORDS.items()))))


def type_default(kind: Column, place: int) -> Column:
    """The default mnemonic (0) or unit (1) of a curve type; null for others."""
    return F.element_at(F.create_map(*(F.lit(x) for k, v in TYPE_DEFAULTS.items() for x in (k, v[place]))), F.upper(F.trim(kind)))


def quality_flags(pct_missing: Column, pct_spikes: Column) -> Column:
    return F.filter(F.array(F.when(pct_missing > 30, F.lit("high_missing")), F.when(pct_spikes > 5, F.lit("spiky"))), lambda x: x.isNotNull())


def scaled_value(x: Column, width: Column, left: Column, right: Column) -> Column:
    return left + x / F.greatest(F.lit(1), width - 1) * (right - left)


def depth_at(row: Column, rows: Column, top: Column, bottom: Column) -> Column:
    return top + row / F.greatest(F.lit(1), rows - 1) * (bottom - top)


def mode_name(mode: Column) -> Column:
    clean = F.lower(F.trim(mode))
    return F.when(F.coalesce(clean, F.lit("")) == "", "black").otherwise(clean)


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def first_metadata(m: Column, key: str) -> Column:
    """The first non-empty of a field's synonyms, stripped; empty where there is none."""
    parts = [F.element_at(m, F.lit(k)) for k in METADATA[key]]
    return stripped(F.coalesce(*(F.when(p != "", p) for p in parts), F.lit("")))


def file_stem(text: Column) -> Column:
    clean = F.regexp_replace(F.regexp_replace(stripped(text), r"\s+", "_"), r"[^A-Za-z0-9_-]", "")
    return F.substring(F.regexp_replace(clean, r"^[_-]+|[_-]+$", ""), 1, 80)


def las_file_name(comp: Column, well: Column, default: str = "digitized_log.las") -> Column:
    c, w = file_stem(F.coalesce(comp, F.lit(""))), file_stem(F.coalesce(well, F.lit("")))
    return F.when((c != "") & (w != ""), F.concat(c, F.lit("__"), w, F.lit(".las"))).when(w != "", F.concat(w, F.lit(".las"))).otherwise(default)


def company_key(name: Column) -> Column:
    return F.regexp_replace(F.lower(stripped(F.coalesce(name, F.lit("")))), r"\s+", " ")


def email_domain(email: Column) -> Column:
    """What follows the first @, or nothing."""
    parts = F.split(F.coalesce(email, F.lit("")), "@", 2)
    return F.when(F.size(parts) == 2, F.lower(stripped(parts[1]))).otherwise("")


def edit_quality(edits: Column, undo: Column, accepted: Column) -> Column:
    q = F.when(edits, 0.8).otherwise(1.0) * F.when(undo, 0.9).otherwise(1.0) * F.when(accepted, 1.2).otherwise(1.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.1), q))


def confidence_band(c: Column) -> Column:
    return F.when(c > 0.7, "high").when(c > 0.4, "medium").otherwise("low")


def holdout_share(key: Column) -> Column:
    """A stable place of 0 to 99.99 from the key's digest."""
    return (F.conv(F.substring(F.sha1(key), 1, 8), 16, 10).cast("long") % 10000) / 100


def numeric_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(-?\d*\.?\d+)"), F.lit(1))


def token_numbers(text: Column, x: Column, y: Column) -> Column:
    """The numbers of a recognised text, each with the place of the text's first corner."""
    return F.transform(numeric_tokens(text), lambda t: F.struct(t.cast("double").alias("value"), t.alias("text"), x.alias("x"), y.alias("y")))


def first_json(text: Column) -> Column:
    """The text, or what stands from its first to its last brace, where that parses as JSON."""
    inner = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    ok = lambda t: F.when(F.try_parse_json(t).isNotNull(), t)
    return F.coalesce(ok(text), ok(inner))


def gray(b: Column, g: Column, r: Column) -> Column:
    return F.round(0.299 * r + 0.587 * g + 0.114 * b).cast("int")


def hsv(b: Column, g: Column, r: Column) -> Column:
    """h 0 to 179, s and v 0 to 255."""
    v, low = F.greatest(b, g, r), F.least(b, g, r)
    d = (v - low).cast("double")
    h = F.when(d == 0, 0.0).when(v == r, 60.0 * (g - b) / d).when(v == g, 120.0 + 60.0 * (b - r) / d).otherwise(240.0 + 60.0 * (r - g) / d)
    h = F.when(h < 0, h + 360).otherwise(h)
    return F.struct((F.round(h / 2) % 180).cast("int").alias("h"), F.when(v == 0, 0).otherwise(F.round(255.0 * d / v)).cast("int").alias("s"), v.alias("v"))


def mode_mask(mode: Column, b: Column, g: Column, r: Column) -> Column:
    """Colour masks in plain integers; any other mode is dark ink."""
    strong = lambda a, x, y: (a > 120) & (a > x + 20) & (a > y + 20)
    return F.when(mode == "red", strong(r, g, b)).when(mode == "green", strong(g, r, b)).when(mode == "blue", strong(b, r, g)).otherwise(F.greatest(b, g, r) <= 80)


def mode_test(mode: str, b, g, r):
    """The same test on arrays of levels."""
    first, *others = {"red": (r, g, b), "green": (g, r, b), "blue": (b, r, g)}.get(mode, (None,))
    if first is None:
        return (b <= 80) & (g <= 80) & (r <= 80)
    return (first > 120) & (first > others[0] + 20) & (first > others[1] + 20)


def hue_mask(colour: str, h: Column, s: Column, v: Column) -> Column:
    """On where hue, saturation and value are of the colour."""
    hue = reduce(lambda a, b: a | b, (h.between(lo, hi) for lo, hi in HUE_BANDS[colour]))
    return hue & (s >= 80) & (v >= 80)
