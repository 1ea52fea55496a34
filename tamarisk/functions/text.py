"""Text expressions: names, labels, tags, file names, flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean_text(c: Column) -> Column:
    """Trimmed text, or null when nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def safe_name(c: Column) -> Column:
    """Letters, digits, '-' and '_' survive; anything else becomes '_'."""
    kept = F.regexp_replace(strip(c), r"[^\p{L}\p{N}_-]", "_")
    return F.coalesce(F.nullif(F.regexp_replace(kept, "^_+|_+$", ""), F.lit("")), F.lit("unnamed_dataset"))


def normal_name(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit(" "), F.lit("_"))


def slug(c: Column) -> Column:
    return F.replace(F.lower(strip(c)), F.lit(" "), F.lit("-"))


def tags(c: Column) -> Column:
    """Comma-separated text to an array of trimmed, non-blank tags."""
    return F.filter(F.transform(F.split(c, ","), strip), lambda t: t != "")


def contains_ci(c: Column, needle: str) -> Column:
    return F.contains(F.lower(c), F.lit(needle.lower()))


def uri_tail(c: Column) -> Column:
    tail = F.element_at(F.split(c, "/"), -1)
    return F.when(tail != "", tail).otherwise(c)


def file_extension(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"(\.[^./]*)$", 1))


def safe_file_name(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\p{L}\p{N}._-]", "_")


def flag(c: Column, data_type: str = "string") -> Column:
    """A boolean from a boolean, a number or text; anything unreadable is false."""
    if data_type == "boolean":
        yes = c
    elif data_type == "string":
        said = F.lower(F.trim(c))
        yes = said.isin("true", "t", "yes", "y") | (said.rlike(r"^[+-]?[0-9]+(\.[0-9]*)?$") & ~said.rlike(r"^[+-]?0+(\.0*)?$"))
    else:
        yes = c != 0
    return F.coalesce(yes, F.lit(False))


def affix_match(name: Column, keyword: str) -> Column:
    return (name == keyword) | name.startswith(keyword + "_") | name.endswith("_" + keyword)


def matched_keyword(name: Column, keywords) -> Column:
    """The first keyword (in list order) that the name equals, starts or ends with."""
    return F.coalesce(*[F.when(affix_match(name, kw), F.lit(kw)) for kw in keywords])


def listed_uris(c: Column) -> Column:
    """A Python-style list of {'uri': ..} records as an array of uris; malformed text is empty."""
    quoted, rest = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|\'[^\'\\]*+(?:\\.[^\'\\]*+)*+\'', r"[^\"\']+"
    pieces = F.regexp_extract_all(c, F.lit(f"{quoted}|{rest}"), F.lit(0))  # strings whole, so that words inside them stay

    def as_json_piece(piece: Column) -> Column:
        word = piece
        for python, json in (("None", "null"), ("True", "true"), ("False", "false")):
            word = F.regexp_replace(word, rf"\b{python}\b", json)
        return F.when(F.rlike(piece, F.lit("^[\"']")), piece).otherwise(word)

    as_json = F.when(F.array_join(pieces, "") == c, F.array_join(F.transform(pieces, as_json_piece), ""))  # else a string has no end
    parsed = F.from_json(as_json, "array<struct<uri:string>>", {"allowSingleQuotes": "true"})
    uris = F.filter(F.transform(parsed, lambda x: x["uri"]), lambda u: u.isNotNull() & (u != ""))
    return F.coalesce(uris, F.array().cast("array<string>"))
