"""Parsing of embedded literals and one-hot encoding, as column functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from daygrain.functions.literals import dict_items, list_items

# Activity labels matched by substring, and heart-rate zone
# names with their Edwards weights.
ACTIVITY_LABELS = ("individual", "running", "endurance", "strength", "team", "soccer",
                   "walk", "bike")
ZONE_WEIGHTS = {
    "BELOW_DEFAULT_ZONE_1": 1.0,
    "IN_DEFAULT_ZONE_1": 2.0,
    "IN_DEFAULT_ZONE_2": 3.0,
    "IN_DEFAULT_ZONE_3": 4.0,
}
ZONE_KEYS = tuple(ZONE_WEIGHTS)
HIGHEST_ZONE = "IN_DEFAULT_ZONE_3"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_map(c: Column | str) -> Column:
    """A dict literal as ``MAP<STRING,STRING>``; anything else is the empty map."""
    return F.coalesce(dict_items(c), F.map_from_arrays(*[F.array().cast("array<string>")] * 2))


def _literal_list(c: Column | str) -> Column:
    return F.coalesce(list_items(c), F.array().cast("array<string>"))


def parse_list(c: Column | str) -> Column:
    """A list or tuple literal as trimmed lower-case names, blanks removed."""
    names = F.transform(_literal_list(c), lambda x: F.lower(F.trim(x)))
    return F.filter(names, lambda x: x != "")


def soreness(c: Column | str) -> Column:
    """``(areas, any_sore, n_zones)`` of a soreness-area literal."""
    areas = _literal_list(c)
    return F.struct(areas.alias("areas"), (F.size(areas) > 0).alias("any_sore"),
                    F.size(areas).alias("n_zones"))


def yes_no(c: Column | str) -> Column:
    """Yes -> 1, No -> 0, anything else NULL."""
    text = F.lower(F.trim(_col(c)))
    return F.when(text == "yes", 1).when(text == "no", 0)


def split_set(c: Column | str, sep: str = ",") -> Column:
    """Separated names, trimmed, blanks dropped; NULL gives the empty list."""
    parts = F.transform(F.split(F.coalesce(_col(c), F.lit("")), sep), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def activity_flag(names: Column | str, label: str) -> Column:
    """1 when any name contains ``label``, ignoring case."""
    found = F.exists(_col(names), lambda n: F.contains(F.lower(n), F.lit(label)))
    return F.coalesce(found, F.lit(False)).cast("int")


def activity_flags(names: Column | str, labels=ACTIVITY_LABELS) -> list[Column]:
    """One ``act_<label>`` flag per label."""
    return [activity_flag(names, label).alias(f"act_{label}") for label in labels]


def or_flags(a: Column | str, b: Column | str) -> Column:
    """Union of two 0/1 flags; an absent side counts as 0."""
    return F.greatest(F.coalesce(_col(a), F.lit(0)), F.coalesce(_col(b), F.lit(0)))


def trimp(zones: Column | str, weights: dict[str, float] = ZONE_WEIGHTS) -> Column:
    """Edwards training impulse: zone minutes times weight, one decimal.

    Zones without a weight add nothing; a NULL map stays NULL.
    """
    zones = _col(zones)
    total = F.lit(0.0)
    for zone, weight in weights.items():
        total = total + F.coalesce(F.try_element_at(zones, F.lit(zone)), F.lit(0.0)) * weight
    return F.when(zones.isNotNull(), F.round(total, 1))


def basename(path: Column | str) -> Column:
    """Last path component."""
    return F.regexp_extract(_col(path), r"([^/]*)$", 1)


def estimate_key(pid: Column | str, day: Column | str, files: Column | str) -> Column:
    """``participant|day|sorted basenames``; the order of the files is irrelevant."""
    names = F.array_sort(F.transform(_col(files), lambda f: basename(f)))
    return F.concat_ws("|", _col(pid).cast("string"), _col(day).cast("string"),
                       F.array_join(names, ","))


def onehot_name(location: Column | str, severity: Column | str) -> Column:
    """Column name of one injury flag."""
    return F.concat(F.lit("inj_"), F.lower(F.trim(_col(location))), F.lit("__"),
                    F.lower(F.trim(_col(severity))))
