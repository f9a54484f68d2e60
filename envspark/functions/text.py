"""Text column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import WEATHER_LABELS

# FIXED VALUES — Vietnamese letters with diacritics and their base letters (lowercase), for
# slugify: NFD accent stripping maps each of these to its base, and đ maps to d.
_VI_FROM = (
    "àáảãạăằắẳẵặâầấẩẫậ"
    "èéẻẽẹêềếểễệ"
    "ìíỉĩị"
    "òóỏõọôồốổỗộơờớởỡợ"
    "ùúủũụưừứửữự"
    "ỳýỷỹỵ"
    "đ"
)
_VI_TO = (
    "aaaaaaaaaaaaaaaaa"
    "eeeeeeeeeee"
    "iiiii"
    "ooooooooooooooooo"
    "uuuuuuuuuuu"
    "yyyyy"
    "d"
)
assert len(_VI_FROM) == len(_VI_TO)


def slugify_vi(name: Column) -> Column:
    """Lower, strip Vietnamese diacritics (đ -> d), keep [a-z0-9] only."""
    lowered = F.lower(name)
    return F.regexp_replace(F.translate(lowered, _VI_FROM, _VI_TO), "[^a-z0-9]", "")


def weather_label(col_name: str) -> str:
    """Weather metric label without its unit suffix."""
    return WEATHER_LABELS.get(col_name, col_name)
