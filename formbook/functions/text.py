"""Text expressions: slugs, canonical names, status words, display formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab
from .expr import col


def _lookup(mapping: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def slugify(c) -> Column:
    """Lower case, runs of other characters become one `_`, none at the ends."""
    body = F.regexp_replace(F.lower(F.trim(col(c))), "[^a-z0-9]+", "_")
    return F.regexp_replace(body, "^_+|_+$", "")


def name_key(c) -> Column:
    return F.lower(F.trim(col(c)))


def canonical_name(c, mapping: dict[str, str] | None = None,
                   min_fragment: int = vocab.MIN_FRAGMENT) -> Column:
    """Exact match, else the longest known fragment, else the slug.

    The vocabulary is a short fixed list, so it is written into the expression:
    a map lookup, then a first-match chain from the longest fragment down. No
    join, and the name column is read once.
    """
    mapping = vocab.NAME_MAP if mapping is None else mapping
    key = name_key(c)
    fragments = sorted((w for w in mapping if len(w) >= min_fragment), key=lambda w: -len(w))
    found = [F.when(key.contains(w), F.lit(mapping[w])) for w in fragments]
    known = F.coalesce(_lookup(mapping, key), *found, slugify(c))
    return F.when(F.coalesce(key, F.lit("")) == "", F.lit("unknown")).otherwise(known)


def is_mapped_name(c, mapping: dict[str, str] | None = None,
                   min_fragment: int = vocab.MIN_FRAGMENT) -> Column:
    """Whether `canonical_name` knows the name (exactly or through a fragment)."""
    mapping = vocab.NAME_MAP if mapping is None else mapping
    key = name_key(c)
    hit = key.isin(*mapping)
    for w in mapping:
        if len(w) >= min_fragment:
            hit = hit | key.contains(w)
    return F.coalesce(hit, F.lit(False))


def status_key(c) -> Column:
    """Trimmed lower-case status with single spaces."""
    return F.lower(F.trim(F.regexp_replace(col(c), r"\s+", " ")))


def status_category(c) -> Column:
    """Normalised status category; blank or unmapped text is `unknown`."""
    key = status_key(c)
    laps_down = F.when(key.rlike(vocab.LAPS_DOWN_PATTERN), F.lit(vocab.FINISHED))
    return F.coalesce(_lookup(vocab.STATUS_MAP, key), laps_down, F.lit(vocab.UNKNOWN))


def classification_flag(c) -> Column:
    """A number is classified, a letter code is not, anything else is unknown."""
    key = F.lower(F.trim(col(c).cast("string")))
    return (F.when(key.isin("", "nan", "none"), F.lit(None).cast("boolean"))
             .when(key.isin(*vocab.UNCLASSIFIED_CODES), F.lit(False))
             .when(key.try_cast("double").isNotNull(), F.lit(True)))


def percent(p) -> Column:
    """`100%`, `>99.9%`, `<0.1%`, otherwise one decimal (half even on the exact binary value)."""
    p = col(p)
    return (F.when(p >= 1.0, F.lit("100%"))
             .when(p >= 0.9995, F.lit(">99.9%"))
             .when(p < 0.0005, F.lit("<0.1%"))
             .otherwise(F.concat(F.format_number(p * 100, 1), F.lit("%"))))


def finish_label(raw) -> Column:
    """The classified place, or the short code of a non-finish."""
    raw = col(raw).cast("string")
    return (F.when(raw.rlike(r"^\d+$"), raw)
             .otherwise(F.coalesce(_lookup(vocab.RESULT_CODES, raw), F.lit("DNF"))))


def place_delta(predicted, label) -> Column:
    """`▲n` gained, `▼n` lost, `=` as predicted; blank without a numeric place."""
    gained = col(predicted) - col(label).try_cast("int")
    return (F.when(gained.isNull(), F.lit(""))
             .when(gained == 0, F.lit("="))
             .when(gained > 0, F.concat(F.lit("▲"), gained.cast("string")))
             .otherwise(F.concat(F.lit("▼"), (-gained).cast("string"))))


def display_name(c) -> Column:
    """Display form of a canonical id."""
    return F.coalesce(_lookup(vocab.DISPLAY_NAMES, col(c)),
                      F.initcap(F.replace(col(c), F.lit("_"), F.lit(" "))))


def event_id(year="year", rnd="round") -> Column:
    return F.concat(col(year).cast("string"), F.lit("-"), F.lpad(col(rnd).cast("string"), 2, "0"))
