"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squash_spaces(x: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def blank_to_null(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def first_non_blank(*xs: Column) -> Column:
    """The first of the columns that is not blank, its white space squashed."""
    return F.coalesce(*[F.nullif(squash_spaces(x), F.lit("")) for x in xs])


def falsy_to(x: Column, default: Column) -> Column:
    """``default`` for null, zero and empty values alike, as ``or`` has it."""
    return F.coalesce(F.nullif(x, F.lit(0)), default)


def rounded(x: Column, places: int = 4) -> Column:
    """Half up at so many decimals, by arithmetic that every engine does alike."""
    scale = float(10**places)
    return F.floor(x * scale + 0.5) / scale


def clamp(x: Column, lo, hi) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def signed_turn(source: Column, target: Column) -> Column:
    """The turn from one azimuth to another, in (-180, 180]."""
    turn = F.pmod(target - source, F.lit(360))
    return F.when(turn > 180, turn - 360).otherwise(turn)


def listed(*cases: tuple[Column, str]) -> Column:
    """The names of the conditions that hold, in the order given."""
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in cases]))


def first_of(*cases: tuple[Column, str], otherwise: str) -> Column:
    """The name of the first condition that holds."""
    out = F
    for condition, name in cases:
        out = out.when(condition, F.lit(name))
    return out.otherwise(F.lit(otherwise))


def slug(x: Column, fallback: str = "item", longest: int = 80) -> Column:
    """Lower case, hyphens for everything but a-z, 0-9, _ and -, none at the ends."""
    s = F.regexp_replace(F.lower(F.trim(x)), r"[^a-z0-9_-]+", "-")
    s = F.substring(F.regexp_replace(s, r"^-+|-+$", ""), 1, longest)
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(fallback))


def paper_id(url: Column) -> Column:
    """The id in an abs or pdf address of a preprint server, without its version; '' if there is none."""
    return F.regexp_extract(F.lower(url), r"arxiv\.org/(?:abs|pdf)/([0-9]{4}\.[0-9]{4,5})", 1)


def derived_seed(x: Column, modulus: int) -> Column:
    """A seed from the first ten hex digits of the SHA-256."""
    return F.pmod(F.conv(F.substring(F.sha2(x.cast("binary"), 256), 1, 10), 16, 10).cast("long"), F.lit(modulus))


def has_any(x: Column, needles: tuple[str, ...]) -> Column:
    """Whether the text, lower-cased, holds one of the needles."""
    low = F.lower(x)
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(low, F.lit(n))
    return out


def last_match(text: Column, pattern: str) -> Column:
    """The first group of the last match, null without one."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lit(-1))


def word_head(x: Column, n: int) -> Column:
    """The first n words, with an ellipsis if there are more."""
    words = F.split(squash_spaces(x), " ")
    head = F.array_join(F.slice(words, 1, n), " ")
    return F.when(F.size(words) > n, F.concat(head, F.lit(" ..."))).otherwise(head)
