"""JSON text in and out of columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


# Strict grammar, whatever the session's defaults for these are.
STRICT = {name: "false" for name in (
    "allowComments", "allowSingleQuotes", "allowUnquotedFieldNames", "allowNumericLeadingZeros",
    "allowBackslashEscapingAnyCharacter", "allowUnquotedControlChars", "allowNonNumericNumbers")}


def is_json(text: Column) -> Column:
    """True for any well-formed JSON document, objects or not; false for blank or broken text.

    The text is read as the first of two members of a list; the second is a digest of the text. Only
    one whole document in front of it gives such a list: more than one, or a text that ends the list
    early, does not. No session setting has a say in that, and members may be named twice.
    """
    mark = F.md5(text.cast("binary"))
    members = F.from_json(F.concat(F.lit("["), text, F.lit(',"'), mark, F.lit('"]')), "array<string>", STRICT)
    return F.coalesce((F.size(members) == 2) & F.get(members, F.lit(1)).eqNullSafe(mark), F.lit(False))


def to_json_text(columns: Sequence[Column | str], keep_nulls: bool = True) -> Column:
    """One JSON object per row; null members are written unless `keep_nulls` is off."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": str(not keep_nulls).lower()})
