"""Text expressions: folds, canonical names, patterns, slugs, Markdown cleaning."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that say nothing about where in a street a property lies.
STREET_WORDS = (
    "rue avenue av avn boulevard bd place chemin ch route allee all impasse imp quai cours passage "
    "square residence lotissement lieu dit ld le la les de du des d l"
).split()
ARCHIVE_WORDS = ["old", ".old", "x - old", "x-old", "x old", "_old", "archive", "archives"]
ARCHIVE_NAMES = ["old", "archive", "archives"]


@cache
def _latin(form: str) -> tuple[str, str]:
    """Letters with marks, and the letters without them, for translate(); built from the Unicode database. No-break and wide blanks are blanks in either form."""
    pairs = []
    for code in (*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0x2000, 0x2070), 0x3000):
        blank = unicodedata.category(chr(code)) == "Zs"
        bare = " " if blank else "".join(c for c in unicodedata.normalize(form, chr(code)) if unicodedata.category(c) != "Mn")
        if len(bare) == 1 and bare != chr(code):
            pairs.append((chr(code), bare))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def let(value: Column, body) -> Column:
    """body(value), the value being computed once however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with a costly column that filters and later columns read, not compute again: no optimiser rule moves them below a generator."""
    return rows.withColumn(name, F.explode(F.array(value)))


def strip(text: Column) -> Column:
    """Without blanks of any kind at the ends, no-break ones too."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def without_marks(text: Column) -> Column:
    """Letters without their accents; other letters stay, blanks of any kind are plain ones."""
    return F.regexp_replace(F.translate(text, *_latin("NFD")), r"\p{Mn}+", "")


def to_ascii(text: Column) -> Column:
    """Letters without their accents; what is not ASCII then goes."""
    return F.regexp_replace(F.translate(text, *_latin("NFKD")), r"[^\x00-\x7F]+", "")


def canonical_name(text: Column) -> Column:
    """A folder, file or key name for comparison: no case, accents, numbering or separators."""
    t = F.translate(F.trim(without_marks(F.lower(text)), F.lit(" \t\n\r\f\x0b")), "_-", "  ")
    t = F.regexp_replace(t, r"^\s*(?:\d+|x)\s*[.)](?!\d)\s*", "")
    t = F.regexp_replace(t, r"\s+\d+\s*$", "")
    return F.coalesce(F.trim(F.regexp_replace(t, r"\s+", " ")), F.lit(""))


def canonical_pattern(text: Column) -> Column:
    """As canonical_name, `*` being kept without spaces around it."""
    marked = F.replace(F.lower(strip(text)), F.lit("*"), F.lit("wildcardtoken"))
    return F.trim(F.regexp_replace(F.replace(canonical_name(marked), F.lit("wildcardtoken"), F.lit("*")), r"\s*\*\s*", "*"))


def stem(filename: Column) -> Column:
    return F.regexp_replace(filename, r"(?<=[^/])\.[^./]*$", "")


def canonical_stem(filename: Column) -> Column:
    return canonical_name(stem(filename))


def segments(path: Column) -> Column:
    return F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: F.trim(p) != "")


def canonical_segments(path: Column) -> Column:
    return F.transform(segments(path), canonical_name)


def _as_regex(pattern: Column) -> Column:
    """`*` stands for anything but a separator; all else for itself."""
    return F.replace(F.regexp_replace(pattern, r"([.+?^$(){}|\[\]\\])", r"\\$1"), F.lit("*"), F.lit("[^/]*"))


def matches_pattern(name: Column, pattern: Column) -> Column:
    p = canonical_pattern(pattern)
    return F.when(p == "", canonical_name(name) == "").otherwise(F.rlike(canonical_name(name), F.concat(F.lit("^"), _as_regex(p), F.lit("$"))))


def path_has_segments(path: Column, target: Column) -> Column:
    """Whether the target's segments stand side by side in the path; both are canonical twice over."""
    return holds_segments(joined_segments(path), target)


def joined_segments(path: Column) -> Column:
    """A path's canonical segments between slashes."""
    source = F.filter(F.transform(canonical_segments(path), canonical_name), lambda s: s != "")
    return F.concat(F.lit("/"), F.array_join(source, "/"), F.lit("/"))


def holds_segments(joined: Column, target: Column) -> Column:
    """As path_has_segments(), of joined_segments()."""
    wanted = F.filter(F.transform(F.transform(segments(target), canonical_pattern), canonical_pattern), lambda s: s != "")
    regex = F.concat(F.lit("/"), F.array_join(F.transform(wanted, _as_regex), "/"), F.lit("/"))
    return (F.size(wanted) == 0) | F.rlike(joined, regex)


def is_archived(path: Column) -> Column:
    parts = segments(path)
    return F.exists(parts, lambda p: F.lower(F.trim(p)).isin(ARCHIVE_WORDS) | canonical_name(p).isin(ARCHIVE_NAMES))


def person_folder(path: Column) -> Column:
    """The folder right below the HR folder, if a file lies deeper in it."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: p != "")
    names = F.transform(parts, canonical_name)
    at = F.aggregate(
        F.sequence(F.size(names), F.lit(1), F.lit(-1)),
        F.lit(0),
        lambda found, i: F.when(F.get(names, i - 1).isin("rh", "ressources humaines"), i).otherwise(found),
    )
    found = F.get(parts, at)
    return F.when((F.size(parts) > 0) & (at > 0) & (at < F.size(parts) - 1) & ~is_archived(path), found)


def street_key(text: Column) -> Column:
    """What tells a street from others: ASCII words that are no numbers and no street words; null if none."""
    words = F.split(F.regexp_replace(F.lower(to_ascii(text)), r"[^a-z0-9]+", " "), " ")
    kept = F.filter(words, lambda w: (w != "") & ~F.rlike(w, F.lit(r"^\d+$")) & ~w.isin(STREET_WORDS))
    return F.when(F.size(kept) > 0, F.array_join(kept, " "))


def address_key(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(to_ascii(text)), r"[^a-z0-9]+", " "))


def slug(text: Column, separator: str = "-", accents: bool = False, saint: bool = False) -> Column:
    """Lower-case words joined by a separator; accents kept or folded; `St` read as `Saint`."""
    t = F.lower(F.trim(text)) if accents else F.lower(to_ascii(F.trim(text)))
    if saint:
        t = F.regexp_replace(t, r"(^|[^a-z0-9])st(e?)(?=[^a-z0-9])", "$1saint$2")
    t = F.regexp_replace(t, r"[^\p{L}\p{N}]+" if accents else r"[^a-z0-9]+", separator)
    return F.trim(t, F.lit(separator))


def without_images(text: Column) -> Column:
    """Markdown without image links, runs of blanks being one."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"!\[.*?\]\(.*?\)", " "), r"[ \t]+", " "))


def is_informative(text: Column) -> Column:
    """Fifty characters at least, ten of them no formatting, and no recurring footer."""
    t = F.trim(text, F.lit(" \t\r\n"))
    bare = F.regexp_replace(t, r"[#*_\-|\s]", "")
    noise = F.rlike(t, F.lit(r"(?i)^(?:#{1,6}\s*)?[\s*_#\-|]*$|^Tous droits de reproduction|^Page \d+"))
    return F.coalesce((F.length(t) >= 50) & (F.length(bare) >= 10) & ~noise, F.lit(False))


def document_id(project: Column, path: Column) -> Column:
    return F.substring(F.sha2(F.concat(project, F.lit("::"), path).cast("binary"), 256), 1, 12)


def token_estimate(text: Column) -> Column:
    """Tokens of a text, four characters each; any other count can take its place."""
    return F.ceil(F.length(text) / 4).cast("int")
