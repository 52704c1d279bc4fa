"""Drawing identity: canonical stems, bases, revisions and sheets, all as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The grammar of a part token in a file name, of a canonical stem and of a part reference.
PART_TOKEN = r"(?i)(?<![A-Z0-9])FC?[0-9]{5,8}(?![0-9])[A-Z0-9_-]*"
CANONICAL = r"^FC?[0-9]{5,8}(?![0-9])[A-Z0-9_]*$"
PART_REF = r"^F[0-9][0-9A-Za-z]*$"
#: Rank that an unapproved (CHK) drawing starts from.
CHK_RANK = -1000


def canonical_stem(name: Column) -> Column:
    """The first part token of a file name, upper-cased, hyphens as underscores; null if there is none."""
    token = F.translate(F.upper(F.regexp_extract(name, PART_TOKEN, 0)), "-", "_")
    return F.when(token.rlike(CANONICAL), token)


def filename_title(name: Column) -> Column:
    """What follows the part token, without separators at its ends; null if nothing does."""
    rest = F.regexp_extract(name, f"{PART_TOKEN}(?s)(.*)$", 1)
    return F.nullif(F.regexp_replace(rest, r"^[ \-_.]+|[ \-_.]+$", ""), F.lit(""))


def base(stem: Column) -> Column:
    return F.substring_index(stem, "_", 1)


def segments(stem: Column) -> Column:
    return F.split(stem, "_")


def is_chk(stem: Column) -> Column:
    """Whether CHK stands after the first underscore."""
    cut = F.instr(stem, "_")
    return (cut > 0) & F.upper(F.substring(stem, cut + 1, F.length(stem))).contains("CHK")


def revision_token(stem: Column) -> Column:
    """The second segment if it is one or two letters, else empty."""
    second = F.get(segments(stem), F.lit(1))
    return F.when(second.rlike("^[A-Za-z]{1,2}$"), second).otherwise("")


def letter_rank(token: Column) -> Column:
    """Bijective base 26 of up to two letters: A is 1, Z 26, AA 27; no letter is 0."""
    value = lambda k: F.ascii(F.substring(F.upper(token), k, 1)) - 64
    return F.when(F.length(token) == 0, 0).when(F.length(token) == 1, value(1)).otherwise(26 * value(1) + value(2))


def revision_rank(stem: Column) -> Column:
    return letter_rank(revision_token(stem)) + F.when(is_chk(stem), CHK_RANK).otherwise(0)


def sheet_token(stem: Column) -> Column:
    """The first later segment that is DWG and digits; null if there is none."""
    later = F.slice(segments(stem), F.lit(2), F.greatest(F.size(segments(stem)) - 1, F.lit(0)))
    return F.get(F.filter(later, lambda s: F.upper(s).rlike("^DWG[0-9]+$")), F.lit(0))


def is_part_ref(ref: Column) -> Column:
    """A reference that the graph follows; FC components are none."""
    return F.coalesce(ref.rlike(PART_REF), F.lit(False))


def is_component(ref: Column) -> Column:
    return F.coalesce(ref.startswith("FC"), F.lit(False))


def used_on_base(value: Column) -> Column:
    """F and its digits, as a declared parent is compared; null for FC numbers and other texts."""
    return F.nullif(F.regexp_extract(F.upper(value), "^F[0-9]+", 0), F.lit(""))
