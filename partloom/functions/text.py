"""Text clean-up: OCR repair, folder names, path lengths, sink hardening."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that OCR takes for digits, and the digits they stand for.
OCR_LETTERS, OCR_DIGITS = "OIL|SB", "011158"
SNAP_LETTERS, SNAP_DIGITS = "OILSB", "01158"
# Characters that a folder name drops (control and bidirectional marks) or replaces.
DROPPED = r'[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F‪-‮⁦-⁩"]'
REPLACED = r"[/<>:\\|?*]"
# White space as Unicode has it, with the separators of ASCII.
SPACE = r"[\s\x1C-\x1F\x85\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F‪-‮⁦-⁩]"


def stripped(text: Column) -> Column:
    """text without white space at its ends, no-break and other wide spaces included."""
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def normalize(text: Column) -> Column:
    """Upper case without white space of any kind; null is empty."""
    return F.upper(F.regexp_replace(F.coalesce(text, F.lit("")), rf"{SPACE}+", ""))


def confusion_fixed(ref: Column) -> Column:
    """F, then the rest with look-alike letters as digits."""
    return F.concat(F.substring(ref, 1, 1), F.translate(F.substring(ref, 2, 1_000_000), SNAP_LETTERS, SNAP_DIGITS))


def ocr_token(word: Column) -> Column:
    """The first alphanumeric run that reads as F and 5 to 8 digits once look-alikes are repaired; null if there is none.

    The runs of the repaired word come first, in which a bar stands for a digit, then those of the word as it is, in which it
    is a border.
    """
    repaired = lambda c: F.translate(c, OCR_LETTERS, OCR_DIGITS)
    runs = lambda c: F.filter(F.split(c, "[^A-Z0-9]+"), lambda r: r.startswith("F"))
    up = F.upper(word)
    every = F.transform(F.concat(runs(repaired(up)), runs(up)), repaired)
    return F.get(F.filter(every, lambda r: r.rlike("^F[0-9]{5,8}$")), F.lit(0))


def edit_distance_one(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b, 1) == 1


def sanitize(name: Column) -> Column:
    """A name that is safe as a folder's."""
    s = F.regexp_replace(F.regexp_replace(name, DROPPED, ""), REPLACED, "-")
    s = F.trim(F.regexp_replace(s, rf"{SPACE}+", " "))
    return F.regexp_replace(s, r"\.+$", "")


def folder_name(stem: Column, name: Column) -> Column:
    """Base number and clean name; the stem where there is no name."""
    clean = sanitize(F.coalesce(name, F.lit("")))
    return F.when(clean != "", F.concat(F.substring_index(stem, "_", 1), F.lit(" "), clean)).otherwise(stem)


def path_units(path: Column, utf16: bool = False) -> Column:
    """Length of a path in code points or in UTF-16 units."""
    return (F.octet_length(F.encode(path, "UTF-16LE")) / 2).cast("int") if utf16 else F.length(path)


def words(text: Column) -> Column:
    """Distinct upper-case alphanumeric tokens."""
    return F.array_distinct(F.array_remove(F.split(F.upper(F.coalesce(text, F.lit(""))), "[^A-Z0-9]+"), ""))


def inert(value: Column) -> Column:
    """A cell that no spreadsheet takes for a formula."""
    clean = F.regexp_replace(value, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    return F.when(clean.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), clean)).otherwise(clean)


def visible(text: Column) -> Column:
    """A log line with control and bidirectional characters as their codes."""
    char = lambda c: F.when(c.rlike(CONTROL), F.when(F.ascii(c) < 256, F.concat(F.lit("\\x"), F.lpad(F.lower(F.hex(F.ascii(c))), 2, "0"))).otherwise(F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(F.ascii(c))), 4, "0")))).otherwise(c)
    return F.when(text.rlike(CONTROL), F.array_join(F.transform(F.split(text, ""), char), "")).otherwise(text)


# Long sides of the ISO A sizes in points, the dots an inch that scans are read at, and the most million dots.
ISO_SIDES, DPI, LEAST_DPI, MEGAPIXELS = (3370, 2384, 1684, 1191, 842), 300, 72, 300


def iso_scale(width: Column, height: Column) -> Column:
    """A page's points for each point of the ISO A size whose long side is nearest by ratio; 1 for pages without extent."""
    long = F.greatest(width, height)
    sizes = F.array(*[F.struct(F.abs(long / s - 1).alias("off"), F.lit(-s).alias("side")) for s in ISO_SIDES])
    return F.when(F.least(width, height) <= 0, F.lit(1.0)).otherwise(long / -F.array_min(sizes)["side"])


def render_dpi(width: Column, height: Column) -> Column:
    """The dots an inch at which a page of so many points stays within MEGAPIXELS."""
    most = F.floor(F.sqrt(F.lit(MEGAPIXELS * 1e6 * 72 * 72) / F.nullif(width * height, F.lit(0.0))))
    return F.when((width > 0) & (height > 0), F.least(F.lit(DPI), F.greatest(F.lit(LEAST_DPI), most))).otherwise(F.lit(DPI)).cast("int")


# A full drawing number, and words that only point at other drawings.
FULL_NUMBER, NUMBER = "^(F[0-9]{8}|FC[0-9]{7})$", "^FC?[0-9]{5,8}$"
POINTERS = ("AND", "OR", "&", "W/", "WITH", "PER", "SEE", "REF", "+")


def ocr_number(word: Column) -> Column:
    """A full drawing number from an OCR word: as it is, repaired, or with its F put back; null for fragments."""
    up = F.upper(F.trim(word))
    fixed = ocr_token(up)
    return F.when(up.rlike(FULL_NUMBER), up).when(fixed.rlike(FULL_NUMBER), fixed).when(up.rlike("^[0-9]{8}$"), F.concat(F.lit("F"), up))


def ocr_number_rank(word: Column) -> Column:
    """0 for a number as it is, 1 for a repaired one, 2 for anything else."""
    up = F.upper(F.trim(word))
    return F.when(up.rlike(NUMBER), 0).when(F.coalesce(ocr_token(up).rlike(NUMBER), F.lit(False)), 1).otherwise(2)


def names_a_part(description: Column) -> Column:
    """Whether a description can name a part: two letters or digits at least, and no bare count."""
    t = F.trim(F.coalesce(description, F.lit("")))
    return (F.length(F.regexp_replace(t, "[^A-Za-z0-9]", "")) >= 2) & ~t.rlike("^[0-9]{1,3}$")


def only_points(description: Column) -> Column:
    """Whether a description holds nothing but drawing numbers and words that join them."""
    rest = F.regexp_replace(F.upper(F.coalesce(description, F.lit(""))), r"\bFC?[0-9]{1,8}[A-Z]?\b", " ")
    tokens = F.filter(F.transform(F.split(rest, r"\s+"), lambda w: F.regexp_replace(w, r"^[.,;:()]+|[.,;:()]+$", "")), lambda w: w != "")
    return (F.size(tokens) > 0) & F.forall(tokens, lambda w: w.isin(*POINTERS))


def name_is_whole(name: Column) -> Column:
    """Whether a name read from a scan has three letters at least."""
    return F.length(F.regexp_replace(F.coalesce(name, F.lit("")), "[^A-Za-z]", "")) >= 3
