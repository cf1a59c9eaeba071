"""Settings as maps: nested JSON by way of VARIANT, and what differs between two runs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_settings(text: Column, path: str = "$") -> Column:
    """The object at ``path`` of a JSON text as a map of texts; null where the text isn't JSON or has no object there."""
    return F.try_variant_get(F.try_parse_json(text), path, "map<string,string>")


def mismatches(saved: Column, now: Column) -> Column:
    """Every setting of ``now`` that ``saved`` lacks or has otherwise, in the order of keys; no entries if they match. A null map has no settings."""
    then = lambda e: F.element_at(F.coalesce(saved, F.create_map().cast("map<string,string>")), e["key"])
    known = lambda e: F.coalesce(F.map_contains_key(saved, e["key"]), F.lit(False))
    text = lambda x: F.coalesce(x, F.lit("null"))

    def said(e: Column) -> Column:
        name = F.concat(F.lit("`"), e["key"], F.lit("` "))
        return F.when(~known(e), F.concat(name, F.lit("is missing from the saved run"))).when(
            ~then(e).eqNullSafe(e["value"]), F.concat(name, F.lit("was "), text(then(e)), F.lit(" and is now "), text(e["value"]))
        )

    entries = F.array_sort(F.map_entries(F.coalesce(now, F.create_map().cast("map<string,string>"))), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
    return F.filter(F.transform(entries, said), lambda x: x.isNotNull())


def check_matches(saved: Column, now: Column) -> Column:
    """Null if all settings match; else one text that names every setting that is missing or differs."""
    found = mismatches(saved, now)
    return F.when(F.size(found) > 0, F.concat(F.lit("the saved run was made with other settings: "), F.array_join(found, "; ")))
