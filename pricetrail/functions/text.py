"""Text normalisation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def nfkc(text: Column) -> Column:
    """Compatibility composition. Meant for values that are not plain ASCII."""

    def compose(values: pd.Series) -> pd.Series:
        import unicodedata

        return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))

    return F.pandas_udf(compose, "string")(text)


# Fixed value: the characters Unicode counts as white space, and the byte-order mark.
WHITE = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def composed(text: Column) -> Column:
    """Composed text; plain ASCII, which composition leaves alone, goes into the Arrow call as null."""
    return F.coalesce(nfkc(F.when(text.rlike(r"[^\x{00}-\x{7F}]"), text)), text)


def trimmed(text: Column) -> Column:
    """Text without white space of any kind at its ends."""
    return F.regexp_replace(text, rf"^{WHITE}+|{WHITE}+$", "")


def normalise_mpn(text: Column) -> Column:
    """Composed, trimmed upper case with punctuation kept."""
    return F.upper(trimmed(composed(text)))


def normalise_manufacturer(text: Column) -> Column:
    """Lower case letters and digits only, after composition."""
    return F.regexp_replace(F.lower(composed(text)), "[^a-z0-9]", "")


def slug(text: Column) -> Column:
    """Lower-case words joined by single hyphens."""
    joined = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")
    return F.regexp_replace(joined, "^-|-$", "")


def strip_markup(html: Column) -> Column:
    """Visible text of a fragment: tags to blanks, two entities, one-space runs."""
    text = F.regexp_replace(html, "<[^>]*>", " ")
    text = F.regexp_replace(text, "&pound;", "£")
    text = F.regexp_replace(text, "&amp;", "&")
    return F.trim(F.regexp_replace(text, "[ \\t\\r\\n\\f]+", " "))


def pounds_to_minor(text: Column) -> Column:
    """First '£1,234.56' in the text as minor units; blanks inside are tolerated."""
    pattern = r"£\s*([0-9,]+)\s*\.\s*([0-9]{2})"
    whole = F.regexp_replace(F.regexp_extract(text, pattern, 1), ",", "")
    pence = F.regexp_extract(text, pattern, 2)
    return F.when(pence != "", whole.try_cast("long") * 100 + pence.try_cast("long"))


def canonical_json(*columns: str) -> Column:
    """JSON object text with keys in code-point order and nulls kept."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})
