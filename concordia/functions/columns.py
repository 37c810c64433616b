"""Column expressions: text and number normalisation, bands, moments. Built-in expressions only."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as missing, and the sex and education codes of the source tables.
MISSING = ("", "nan", "None", "none", "N/A", "n/a")
EDUCATION = {
    "1": "Primary", "PRIMARIA": "Primary", "PRIMARY": "Primary", "2": "Secondary", "SECUNDARIA": "Secondary", "SECONDARY": "Secondary",
    "BACHILLERATO": "Secondary", "G": "University", "GRADO": "University", "UNIVERSITARIO": "University", "UNIVERSIDAD": "University",
    "M": "University", "MASTER": "University", "D": "University", "DOCTORADO": "University", "PHD": "University",
}
FEMALE, MALE = ("f", "female", "femenino", "mujer", "woman"), ("m", "male", "masculino", "hombre", "man")
#: The outcomes that model names end in, and the labels of bands and of how far agreement goes.
TARGETS = ("sdmt_paper_score", "tmt_paper_score_a", "tmt_paper_score_b", "tmt_paper_errors_a", "tmt_paper_errors_b")
DURATION_BANDS, EDSS_BANDS = ("Disease_short", "Disease_mid", "Disease_long"), ("EDSS_mild", "EDSS_moderate", "EDSS_advanced")
COGNITIVE_BANDS, PHYSICAL_BANDS = ("Cog_low", "Cog_moderate", "Cog_high"), ("Phys_low", "Phys_moderate", "Phys_high")
POOR, MIDDLING, GOOD = "Needs major improvement", "Exploratory / moderate", "Promising for discussion"
#: Code points of letters with marks, of full-width and raised forms, and of ligatures.
_MARKED = [*range(0xA0, 0x250), *range(0x2070, 0x20A0), *range(0x370, 0x530), *range(0x1E00, 0x2000), *range(0xFF01, 0xFF5F)]
_JOINED = [0x132, 0x133, 0x149, *range(0x1C4, 0x1CD), *range(0x1F1, 0x1F4), *range(0xFB00, 0xFB07)]


def _plain(code: int) -> str:
    """A character's compatibility decomposition, in lower case and without combining marks."""
    return "".join(c for c in unicodedata.normalize("NFKD", chr(code).lower()) if not unicodedata.combining(c)).lower()


_TO = {chr(c): t for c in _MARKED if len(t := _plain(c)) == 1 and t != chr(c)}
ACCENTED, PLAIN = "".join(_TO), "".join(_TO.values())
LIGATURES = {chr(c): t for c in _JOINED if len(t := _plain(c)) > 1}


def nulled(c: Column) -> Column:
    """c, null where it holds a missing-value token."""
    t = F.trim(c)
    return F.when(~t.isin(*MISSING), t)


def number(c: Column) -> Column:
    """A number in either decimal notation: with both marks, points group; a comma is the decimal mark. Null if it isn't one."""
    both = F.contains(c, F.lit(",")) & F.contains(c, F.lit("."))
    return F.replace(F.when(both, F.replace(c, F.lit("."), F.lit(""))).otherwise(c), F.lit(","), F.lit(".")).try_cast("double")


def lookup_text(c: Column) -> Column:
    """Lower case, in compatibility decomposition without combining marks, underscores and runs of white space as one blank."""
    out = F.translate(F.lower(c), ACCENTED, PLAIN)
    for joined, apart in LIGATURES.items():
        out = F.replace(out, F.lit(joined), F.lit(apart))
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"\p{M}+", ""), r"[_\s]+", " "))


def lookup_name(name: str) -> str:
    """lookup_text() of a column's name: what names are compared by."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", name.lower()) if not unicodedata.combining(c))
    return " ".join(plain.replace("_", " ").split())


def person(c: Column) -> Column:
    return F.upper(F.trim(c.cast("string")))


def base_person(c: Column) -> Column:
    return F.split(person(c), "-", 2)[0]


def cut(c: Column, edges: list[float], labels: list[str], right: bool = True) -> Column:
    """The label of the interval that c falls in, closed on the right (or left); null outside all."""
    out = F.lit(None).cast("string")
    for lo, hi, label in reversed(list(zip(edges[:-1], edges[1:], labels, strict=True))):
        inside = (c > lo) & (c <= hi) if right else (c >= lo) & (c < hi)
        out = F.when(inside, F.lit(label)).otherwise(out)
    return out


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is nought."""
    return a / F.nullif(b, F.lit(0.0))


def within(c: Column, low: float, high: float) -> Column:
    """c, null outside low to high."""
    return F.when(c.between(low, high), c)


def age_at(assessed: Column, born: Column) -> Column:
    """Whole days from birth to assessment in years of 365.25 days; null outside 0 to 120."""
    return within(F.floor(days_between(assessed, born)) / F.lit(365.25), 0, 120)


def age_band(c: Column) -> Column:
    return cut(c, [-0.001, 39.999, 54.999, 120], ["<40", "40-54", "55+"])


def disease_years(c: Column) -> Column:
    """Years with the disease as a number; null outside 0 to 80."""
    return within(number(c.cast("string")), 0, 80)


def disease_band(c: Column) -> Column:
    return cut(c, [-0.001, 5, 15, 80], list(DURATION_BANDS))


def visit_gap(assessed: Column, measured: Column, most: float = 365) -> Column:
    """Fractional days from measurement to assessment; null beyond `most` days either way."""
    return within(days_between(assessed, measured), -most, most)


def edss_band(c: Column) -> Column:
    return cut(c, [-0.001, 2.5, 4.5, 10], list(EDSS_BANDS))


def cognitive_burden_band(c: Column) -> Column:
    return cut(c, [-0.001, 17, 30, 60], list(COGNITIVE_BANDS))


def physical_impact_band(c: Column) -> Column:
    return cut(c, [-0.001, 29, 50, 100], list(PHYSICAL_BANDS))


def sex_binary(c: Column) -> Column:
    t = F.lower(F.trim(c))
    return F.when(t.isin(*FEMALE), 1.0).when(t.isin(*MALE), 0.0)


def education_band(c: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in EDUCATION.items() for x in pair]), F.upper(F.trim(c)))


def clinical_group(sheet: Column) -> Column:
    t = F.lower(F.trim(sheet))
    return F.when(F.contains(t, F.lit("control")), "Controles").when(t == "em", "EM").otherwise(sheet)


def days_between(a: Column, b: Column) -> Column:
    """Fractional days from b to a."""
    return (F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))) / 8.64e10


def status(r2: Column, ccc: Column, icc: Column) -> Column:
    """How far a model's agreement goes. A missing measure fails no test, so it counts as good."""
    poor, middling = (r2 < 0) | (ccc < 0.4), (ccc < 0.7) | (icc < 0.7)
    return F.when(poor, POOR).when(middling, MIDDLING).otherwise(GOOD)


def assessment(model: Column) -> Column:
    """The test that a model's name speaks of, or `Unknown`."""
    low = F.lower(model)
    return F.when(F.contains(low, F.lit("sdmt")), "SDMT").when(F.contains(low, F.lit("tmt")), "TMT").otherwise("Unknown")


def target(model: Column) -> Column:
    """The outcome that a model's name ends in, else the name; `Unknown` for null."""
    return F.coalesce(*[F.when(F.endswith(model, F.lit(t)), F.lit(t)) for t in TARGETS], model, F.lit("Unknown"))
