"""Dialect regions: label ids and the spellings of their names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Label id and name of each region (fixed values).
REGIONS = {0: "Basel", 1: "Bern", 2: "Innerschweiz", 3: "Ostschweiz", 4: "Wallis", 5: "Zürich", 6: "Graubünden", 7: "German", 8: "Vorarlberg"}
#: Folded names, those in other languages included (fixed values).
SPELLINGS = {
    "basel": 0, "bale": 0, "basle": 0, "basilea": 0,
    "bern": 1, "berne": 1, "berna": 1,
    "innerschweiz": 2, "zentralschweiz": 2,
    "ostschweiz": 3,
    "wallis": 4, "valais": 4, "vallese": 4,
    "zuerich": 5, "zurich": 5, "zurigo": 5,
    "graubuenden": 6, "graubunden": 6, "grisons": 6, "grigioni": 6,
    "german": 7, "deutsch": 7, "hochdeutsch": 7, "allemand": 7,
    "vorarlberg": 8,
}


def region_label(name: Column) -> Column:
    """Label id of the region that a text names in any spelling (case, spacing, hyphens, umlauts, Unicode form); NULL
    if it names none."""
    plain = F.translate(F.lower(name), "âàáéèêëîïíôòóûùúç", "aaaeeeeiiiooouuuc")
    plain = F.regexp_replace(F.replace(F.replace(F.replace(plain, F.lit("ä"), F.lit("ae")), F.lit("ö"), F.lit("oe")), F.lit("ü"), F.lit("ue")), "[^a-z]", "")
    lookup = F.create_map(*[F.lit(x) for kv in SPELLINGS.items() for x in kv])
    return F.try_element_at(lookup, plain)
