"""Normalisation of names and addresses, as column expressions.

Null is the empty string throughout. Latin letters with marks are folded by `translate`, inside generated code; other
scripts go through one Arrow function, which `scripts="latin"` leaves out of the plan.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Legal suffixes.
LEGAL_SUFFIXES = (
    "pvt ltd", "private limited", "pvt limited", "private ltd", "ltd", "limited", "corp", "corporation", "inc",
    "incorporated", "llc", "gmbh", "sarl", "sas", "sci", "eurl", "co", "company", "plc",
)
# Address abbreviations.
ADDRESS_WORDS = {"rd": "road", "st": "street", "blvd": "boulevard", "ave": "avenue", "dr": "drive", "ln": "lane", "pl": "place", "ct": "court", "pt": "point"}
#: Letters that decomposition leaves alone.
LIGATURES = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "þ": "th", "Þ": "TH", "ð": "d", "Ð": "D", "ı": "i"}
SUFFIX_PATTERN = r"\b(" + "|".join(sorted(LEGAL_SUFFIXES, key=len, reverse=True)) + r")\b"


def _marked_letters() -> tuple[str, str]:
    """Latin letters with marks, U+00C0 to U+024F and U+1E00 to U+1EFF, and the letters that they become."""
    one = [(chr(c), unicodedata.normalize("NFKD", chr(c))[0]) for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]]
    pairs = [(a, b) for a, b in one if b.isascii() and a != b and a not in LIGATURES] + [(a, b) for a, b in LIGATURES.items() if len(b) == 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_MARKED, _PLAIN = _marked_letters()


def fold_latin(c: Column) -> Column:
    """Latin letters without marks, ligatures spelled out."""
    for a, b in LIGATURES.items():
        if len(b) > 1:
            c = F.replace(c, F.lit(a), F.lit(b))
    return F.translate(c, _MARKED, _PLAIN)


def _spoken(ch: str, after: str) -> str:
    """An Indic letter or sign by its Unicode name; other characters by decomposition."""
    name = unicodedata.name(ch, "")
    words = name.split()
    if " LETTER " in name:
        sound = words[-1].lower()
        sound = {"vocalic": "r"}.get(sound, sound)
        if len(sound) > 1 and sound.endswith("a") and not set(sound[:-1]) <= set("aeiou"):
            mark = unicodedata.name(after, "") if after else ""
            return sound[:-1] if " VOWEL SIGN " in mark or mark.endswith("SIGN VIRAMA") else sound
        return sound
    if " VOWEL SIGN " in name:
        return words[-1].lower()
    if name.endswith(("SIGN ANUSVARA", "SIGN BINDI", "SIGN CANDRABINDU", "TIPPI")):
        return "n"
    if name.endswith("SIGN VISARGA"):
        return "h"
    if " DIGIT " in name:
        return str(unicodedata.digit(ch, ""))
    return "".join(x for x in unicodedata.normalize("NFKD", LIGATURES.get(ch, ch)) if x.isascii())


def transliterate_text(t: str) -> str:
    return t if t.isascii() else "".join(c if c.isascii() else _spoken(c, t[i + 1 : i + 2]) for i, c in enumerate(t))


@F.pandas_udf(T.StringType())
def _transliterate(s: pd.Series) -> pd.Series:
    return s.map(transliterate_text)


def transliterate(c: Column, scripts: str = "all") -> Column:
    folded = fold_latin(c)
    return _transliterate(folded) if scripts == "all" else folded


def present(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def remove_punctuation(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\w\s]", " ")


def collapse_whitespace(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def norm_text(c: Column, scripts: str = "all") -> Column:
    return collapse_whitespace(remove_punctuation(F.lower(transliterate(c, scripts))))


def words(c: Column) -> Column:
    """The words between blanks; none of an empty text."""
    return F.filter(F.split(c, " ", -1), lambda w: w != "")


def legal_suffix(name: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(name, F.lit(SUFFIX_PATTERN), F.lit(1)))), " ")


def name_core(name: Column) -> Column:
    core = collapse_whitespace(F.regexp_replace(name, SUFFIX_PATTERN, " "))
    return F.when(core == "", name).otherwise(core)


def token_signature(c: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(words(c))), "|")


def number_tokens(c: Column) -> Column:
    return F.array_join(F.filter(words(c), lambda w: w.rlike("[0-9]")), "|")


def postal_code(c: Column) -> Column:
    return F.coalesce(F.try_element_at(F.regexp_extract_all(c, F.lit(r"\b\d{5,6}\b"), F.lit(0)), F.lit(-1)), F.lit(""))


def has_non_ascii(c: Column) -> Column:
    return c.rlike(r"[^\x00-\x7F]")


def mapped(tokens: Column, table: dict[str, str]) -> Column:
    """Each token by the table, or as it is."""
    lookup = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.transform(tokens, lambda t: F.coalesce(F.try_element_at(lookup, t), t))


def norm_address(c: Column, scripts: str = "all") -> Column:
    return F.array_join(mapped(words(norm_text(c, scripts)), ADDRESS_WORDS), " ")


def normalize_source(raw: DataFrame, scripts: str = "all") -> DataFrame:
    """Raw records in the contract of normalised ones; a row each, nulls as empty strings."""
    a = raw.select(F.col("entity_id").cast("string").alias("entity_id"), F.col("country").cast("string").alias("country"), present("business_name").alias("name_raw"), present("business_address").alias("address_raw"))
    b = a.withColumns({"name_norm": norm_text(F.col("name_raw"), scripts), "address_norm": norm_address(F.col("address_raw"), scripts), "is_non_latin": has_non_ascii(F.col("name_raw"))})
    c = b.withColumns({"name_core": name_core(F.col("name_norm")), "legal_suffix": legal_suffix(F.col("name_norm"))})
    return c.select(
        "entity_id", "country", "name_raw", "name_norm", "name_core", "legal_suffix", token_signature(F.col("name_core")).alias("name_tokens"), F.col("name_norm").alias("name_transliterated"),
        "is_non_latin", "address_raw", "address_norm", number_tokens(F.col("address_norm")).alias("address_numbers"), postal_code(F.col("address_norm")).alias("address_pin"),
    )


def apply_token_map(records: DataFrame, table: DataFrame) -> DataFrame:
    """Names of records with each token replaced by the table (token, replacement). A token without replacement stays. The table is
    joined by token, so that its size doesn't matter; name_raw and legal_suffix stay."""
    cols = records.columns
    out = records
    for c in ("name_norm", "name_core"):
        each = out.select("entity_id", F.posexplode_outer(words(F.col(c))).alias("_p", "_t"))
        new = each.join(table.select(F.col("token").alias("_t"), "replacement"), "_t", "left").groupBy("entity_id")
        new = new.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_p", F.coalesce("replacement", "_t").alias("w")))), lambda x: x["w"]), " ").alias("_new"))
        out = out.drop(c).join(new, "entity_id").withColumnRenamed("_new", c)
    return out.withColumns({"name_tokens": token_signature(F.col("name_core")), "name_transliterated": F.col("name_norm")}).select(*cols)
