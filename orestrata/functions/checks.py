"""Checks of entities as lists of messages, and tests of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and signs that the checks look for.
UNITS = ("ppm", "ppb", "ppt", "%", "wt%", "g/t", "mg/t", "oz/t", "lb/t", "vol%")
LOCATION_TYPES = ("drill_hole", "sample_site", "mine", "claim", "prospect", "outcrop")
CONFUSED = (("O", "0"), ("l", "1"), ("I", "1"), ("S", "5"), ("B", "8"), ("G", "6"))
TERMS = (
    "granite", "basalt", "sandstone", "limestone", "shale", "schist", "gneiss", "marble", "quartzite", "fault", "fold",
    "joint", "bedding", "cleavage", "foliation", "vein", "stockwork", "disseminated", "silicification", "sericitization",
    "chloritization", "propylitization",
)
RARE_EARTH = (
    "rare earth", "rare-earth", "ree", "bastnaesite", "bastnäsite", "monazite", "xenotime", "allanite", "lanthanum", "cerium",
    "praseodymium", "neodymium", "samarium", "europium", "gadolinium", "terbium", "dysprosium", "holmium", "erbium", "thulium",
    "ytterbium", "lutetium", "yttrium",
)
ELEMENTS = (
    "H", "He", "Li", "Be", "B", "C", "N", "O", "F", "Ne", "Na", "Mg", "Al", "Si", "P", "S", "Cl", "Ar",
    "K", "Ca", "Sc", "Ti", "V", "Cr", "Mn", "Fe", "Co", "Ni", "Cu", "Zn", "Ga", "Ge", "As", "Se", "Br", "Kr",
    "Rb", "Sr", "Y", "Zr", "Nb", "Mo", "Tc", "Ru", "Rh", "Pd", "Ag", "Cd", "In", "Sn", "Sb", "Te", "I", "Xe",
    "Cs", "Ba", "La", "Ce", "Pr", "Nd", "Pm", "Sm", "Eu", "Gd", "Tb", "Dy", "Ho", "Er", "Tm", "Yb", "Lu", "Hf",
    "Ta", "W", "Re", "Os", "Ir", "Pt", "Au", "Hg", "Tl", "Pb", "Bi", "Po", "At", "Rn", "Fr", "Ra", "Ac", "Th",
    "Pa", "U", "Np", "Pu", "Am", "Cm", "Bk", "Cf", "Es", "Fm", "Md", "No", "Lr", "Rf", "Db", "Sg", "Bh", "Hs",
    "Mt", "Ds", "Rg", "Cn", "Nh", "Fl", "Mc", "Lv", "Ts", "Og",
)


def messages(*checks: tuple[Column, str]) -> Column:
    """The messages whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(m)) for c, m in checks]))


def element_known(element: Column) -> Column:
    """A symbol as written, or a one-letter symbol in lower case."""
    return element.isin(*ELEMENTS) | F.upper(element).isin(*[e for e in ELEMENTS if len(e) == 1])


def _out_of_range(c: Column) -> Column:
    return ~c.between(0, 1)


def assay_errors(assay: Column | None = None) -> Column:
    """Faults of an assay: of the row's own columns, or of a struct that also has a ``confidence``."""
    of = F.col if assay is None else assay.getField
    v, d = of("value"), of("detection_limit")
    found = [
        (~element_known(of("element")), "unknown element"),
        (v < 0, "negative value"),
        (v > 1_000_000, "value too large"),
        (~of("unit").isin(*UNITS), "unknown unit"),
        (d < 0, "negative detection limit"),
        (d > v, "detection limit above value"),
    ]
    if assay is not None:
        empty = F.coalesce(of("element"), F.lit("")) == ""
        found = [(empty, "no element"), (~empty & found[0][0], found[0][1]), *found[1:], (_out_of_range(of("confidence")), "confidence out of range")]
    return messages(*found)


def _nested(lists: Column, faults, name: str) -> Column:
    """Faults of each item of a list, with its kind and place from 0."""
    return F.flatten(F.transform(lists, lambda x, i: F.transform(faults(x), lambda e: F.concat(F.lit(f"{name} "), i.cast("string"), F.lit(": "), e))))


def sample_errors(assays: Column | None = None) -> Column:
    """Faults of a sample, and after its depths those of its ``assays``, if they are given."""
    a, b, c = F.col("depth_from"), F.col("depth_to"), F.col("confidence")
    own = messages(
        (F.coalesce(F.col("sample_id"), F.lit("")) == "", "no id"),
        (a >= b, "from not above to"),
        (a < 0, "negative from"),
        (b < 0, "negative to"),
    )
    last = messages((_out_of_range(c), "confidence out of range"))
    return F.concat(own, last) if assays is None else F.concat(own, _nested(assays, assay_errors, "Assay"), last)


def coordinate_errors(coordinate: Column) -> Column:
    """Faults of a coordinate (a struct); what it lacks is no fault."""
    of = coordinate.getField
    return messages(
        (~of("latitude").between(-90, 90), "latitude out of range"),
        (~of("longitude").between(-180, 180), "longitude out of range"),
        (~of("easting").between(0, 1e6), "easting out of range"),
        (~of("northing").between(0, 1e7), "northing out of range"),
        (_out_of_range(of("confidence")), "confidence out of range"),
    )


def location_errors(coordinates: Column | None = None) -> Column:
    """Faults of a location with one place, or of one with a list of ``coordinates``, whose faults come after its type's."""
    kind = messages((~F.col("location_type").isin(*LOCATION_TYPES), "unknown type"))
    if coordinates is None:
        places = messages((~F.col("latitude").between(-90, 90), "latitude out of range"), (~F.col("longitude").between(-180, 180), "longitude out of range"))
    else:
        places = _nested(coordinates, coordinate_errors, "Coordinate")
    return F.concat(kind, places, messages((~F.col("elevation").between(-1000, 10000), "elevation out of range"), (_out_of_range(F.col("confidence")), "confidence out of range")))


def ocr_suspects(text: Column) -> Column:
    """How many pairs of easily confused characters both occur, and how many numbers above a million."""
    pairs = sum((F.when(F.contains(text, F.lit(a)) & F.contains(text, F.lit(b)), 1).otherwise(0) for a, b in CONFUSED), F.lit(0))
    return pairs + F.size(F.filter(F.regexp_extract_all(text, F.lit(r"\d+\.?\d*"), F.lit(0)), lambda x: x.cast("double") > 1_000_000))


def terms_found(text: Column) -> Column:
    t = F.lower(text)
    return sum((F.contains(t, F.lit(w)).cast("int") for w in TERMS), F.lit(0))


def rare_earth(*columns: Column) -> Column:
    """Whether any column holds a keyword as a part of its text, in any case."""
    out = F.lit(False)
    for c in columns:
        out = out | F.lower(F.coalesce(c, F.lit("nan"))).rlike("|".join(RARE_EARTH))
    return out
