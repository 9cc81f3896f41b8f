"""Text predicates, normalisation and scoring as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Terms of column headers by class, in the order of the classes.
HEADER_TERMS = {
    "name": ["namn", "nimi", "name"],
    "male": ["miespuoli", "mp", "miehenp"],
    "female": ["naispuoli", "vp", "vaimonp"],
}
# Headers of columns that say where people moved from, and where they moved to.
MOVE_FROM = [
    "(muuttokirjan)paikka", "mistä seurakunnasta muutettiin", "tulopaikka", "mistä seurakunnasta on tullut", "mistä", "mistä muuttanut",
    "mistä muuttavat", "seurakunta, josta muutti", "seurakunta, mistä muuttanut", "seurakunta, josta muuttaa", "seurak nimi josta on tullut",
    "paikka, josta tuli", "paikka josta muutti", "från vilken församling inflyttningen skett", "hvarifrån kommen", "hvarifrån de inflyttat",
    "muuttopaikka", "församling, dit utflytning skett",
]
MOVE_TO = [
    "mihin seurakuntaan on mennyt", "mihin", "mihin muuttanut", "mihin muuttavat", "mihinkä", "lähtöpaikka",
    "maa, jonne muutto ilmotettu tahi otaksutaan tapahtuneeksi", "paikka, johon muutto tapahtuu", "paikka, johon muuttaa", "seurakunta, johon muutettiin",
    "seurakunta, johon muutti", "seurakunta mihin muuttaa", "seurakunta, johon muuttaa", "seurak. nimi johon muuttaa", "hvart flyttat", "flyttet till",
    "muuttopaikka", "församling, dit utflytning skett",
]
# Layouts that are known.
LAYOUTS = ["free text", "empty", "wrong", "digital", "handrawn", "halfbook", "print 13a", "print 13b"]
VARIANTS = ["in", "out", "in/out", "out/in", "misc", "abroad"]
# Literal dittos, and the patterns of dittos of the two looser vocabularies.
DITTO_LITERALS = ['"', "S", "s.", "s", "5", "5."]
DITTO = r'^("+|[Dd]o?\.?|[Ss][nm]\.?)$'
DITTO_NARROW = r'^("|[Dd]o?\.?)$'
# File name of a scanned opening.
FILE_NAME = r"^(?:autods_|mands-)([a-z_]+)_([a-z_]+)_(\d{4}-\d{4})_(.+)_(\d+)\.%s$"


def strip(text: Column | str) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def norm(text: Column | str) -> Column:
    """Lower case without white space."""
    return F.lower(F.regexp_replace(text, r"\s+", ""))


def is_ditto(text: Column | str) -> Column:
    return F.regexp_replace(text, r"\s+", "").rlike(DITTO)


def is_ditto_literal(text: Column | str) -> Column:
    stripped = strip(text)
    return stripped.isin(*DITTO_LITERALS)


def squeezed(text: Column | str) -> Column:
    """Without any white space."""
    return F.regexp_replace(text, r"\s+", "")


def is_ditto_narrow(text: Column | str) -> Column:
    return squeezed(text).rlike(DITTO_NARROW)


def is_numeric(text: Column | str) -> Column:
    """Digits and `.,/-` alone, a digit first; white space does not count."""
    return squeezed(text).rlike(r"^\d[\d.,/-]*$")


def is_special_only(text: Column | str) -> Column:
    """One character that is no word character and no double quote; white space does not count."""
    return squeezed(text).rlike(r'^(?U)[^\w"]$')


def annotation_class(text: Column) -> Column:
    """empty, numeric, special, same-as or text: the first that an annotation is."""
    return F.when(text == "", "empty").when(is_numeric(text), "numeric").when(is_special_only(text), "special").when(is_ditto_narrow(text), "same-as").otherwise("text")


def header_class(header: Column | str) -> Column:
    """name, male, female, parish or unknown: the first class of which a term is part of the header."""
    low = F.lower(header)
    classes = HEADER_TERMS | {"parish": list(dict.fromkeys(MOVE_TO + MOVE_FROM))}
    out = None
    for kind, terms in classes.items():
        hit = low.contains(terms[0])
        for term in terms[1:]:
            hit = hit | low.contains(term)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("unknown")


def layout_known(layout: Column) -> Column:
    names = LAYOUTS + [f"print {i}" for i in range(1, 56)] + [f"{base} {v}" for base in ("handrawn", "halfbook", "free text") for v in VARIANTS]
    return layout.isin(*names)


def layout_category(layout: Column) -> Column:
    out = F.when(layout.startswith("print"), "print")
    for kind in ("handrawn", "halfbook", "free text"):
        out = out.when(layout.startswith(kind), kind)
    return out.otherwise("other")


def in_out(text: Column) -> Column:
    """in, out, in/out or out/in at the end of a layout name, else empty."""
    return F.regexp_extract(F.lower(strip(text)), r"\b(in/out|out/in|in|out)$", 1)


def is_printed(layout: Column) -> Column:
    return F.lower(layout).contains("print")


def book_parish(book: Column) -> Column:
    """The parish in a book's name: what stands before `muuttaneet`, without prefix and last underscore."""
    return F.regexp_replace(F.replace(F.get(F.split(book, "muuttaneet"), F.lit(0)), F.lit("autods_"), F.lit("")), "_$", "")


def clean_basename(path: Column) -> Column:
    """The file name without folder, extension and the marks of debug and coordinate files."""
    return F.regexp_replace(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", ""), r"^(debug_)?(coords_)?", "")


def without_number(name: Column) -> Column:
    """Without a leading number and its underscore."""
    return F.regexp_replace(name, r"^\d+_", "")


def short_book_id(parish: Column, doctype: Column, years: Column, source: Column) -> Column:
    """The book's key with the last part of the source alone."""
    return F.concat_ws("_", parish, doctype, years, F.lower(F.element_at(F.split(source, "_"), -1)))


def page_key(path: Column) -> Column:
    """(parish, book folder, file stem) of a page's path, by which annotated and predicted pages meet."""
    parts = F.split(path, "/")
    return F.struct(F.get(parts, F.size(parts) - 4).alias("parish"), F.get(parts, F.size(parts) - 3).alias("book"), F.regexp_replace(F.get(parts, F.size(parts) - 1), r"^(mands-|autods_)|\.[^.]*$", "").alias("stem"))


def file_meta(name: Column | str, extension: str = "xml", prefixes: str = "autods_|mands-") -> Column:
    """Struct of parish, doctype, year_range, source, page_number and book_id from a file name; null where it does not fit.
    Images have the prefix `autods_` alone, annotated files of some sets `mands-` alone."""
    pattern = FILE_NAME.replace("autods_|mands-", prefixes) % extension
    parts = ("parish", "doctype", "year_range", "source", "page_number")
    got = [F.nullif(F.regexp_extract(name, pattern, i + 1), F.lit("")).alias(p) for i, p in enumerate(parts)]
    return F.struct(*got[:4], got[4].cast("int").alias("page_number"), F.lower(F.concat_ws("_", *got[:4])).alias("book_id"))


def opening_of(stem: Column) -> Column:
    return F.element_at(F.split(stem, "_"), -1).try_cast("int")


def year_mean(name: Column) -> Column:
    years = [F.nullif(F.regexp_extract(name, r"(\d{4})-(\d{4})", i), F.lit("")).cast("double") for i in (1, 2)]
    return (years[0] + years[1]) / 2


def cleaned_value(*fields: Column) -> Column:
    """Fields joined by a space, without the words for nothing."""
    joined = F.concat_ws(" ", *[F.coalesce(f, F.lit("")) for f in fields])
    return strip(F.regexp_replace(joined, "None|Unknown", ""))


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance (lower case, stripped) over the longer unstripped length; 1 if b (over 3 characters) is one of two words of a."""
    two = (F.size(F.split(a, " ")) == 2) & (F.length(b) > 3) & ((b == F.get(F.split(a, " "), F.lit(0))) | (b == F.get(F.split(a, " "), F.lit(1))))
    longest = F.greatest(F.length(a), F.length(b), F.lit(1))
    return F.when(two, F.lit(1.0)).otherwise(1 - F.levenshtein(F.lower(strip(a)), F.lower(strip(b))) / longest)
