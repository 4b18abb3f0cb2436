"""Scripts as a reader of page images names them, and the languages to read them with."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.lists import LANGUAGES
from ..functions.text import col

# fixed values: the reader's names of languages and scripts where they differ from the catalogue's, and the language that any page is read with at need
ALIASES = {"zho": "chi_sim"}
SUFFIXES = {
    "Latin": "Latn", "Cyrillic": "Cyrl", "Arabic": "Arab", "Greek": "Grek", "Hebrew": "Hebr", "Devanagari": "Deva", "Han": "Hans", "HanS": "Hans", "HanT": "Hans",
    "Japanese": "Jpan", "Hiragana": "Jpan", "Katakana": "Jpan",
}
OWN = {"HanT": ["chi_tra"]}
FALLBACK = "eng"
#: Languages of one reading, and the confidence from which on a script found counts.
MOST, LEAST_CONFIDENCE = 3, 2.0


def _map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def reader_code(source) -> Column:
    """The reader's name of a catalogue code, installed or not."""
    base = F.substring_index(col(source), "_", 1)
    return F.coalesce(F.try_element_at(_map(ALIASES), base), base)


def reading_language(source, installed: Column) -> Column:
    """The language to read a source with; the fallback for "auto" and what isn't installed. An empty list knows nothing and refuses nothing."""
    code = reader_code(source)
    return F.when((col(source) == "auto") | ((F.size(installed) > 0) & ~F.array_contains(installed, code)), FALLBACK).otherwise(code)


def probe_languages(script, installed: Column, most: int = MOST) -> Column:
    """The first installed languages of a script in the catalogue's order, joined by "+"; else the fallback."""
    choices = {}
    for name, suffix in SUFFIXES.items():
        codes = [c for c in LANGUAGES.values() if c.endswith(suffix)]
        choices[name] = list(dict.fromkeys([*OWN.get(name, []), *(ALIASES.get(c.split("_")[0], c.split("_")[0]) for c in codes)]))
    table = F.create_map(*(x for name, codes in choices.items() for x in (F.lit(name), F.array(*map(F.lit, codes)).cast("array<string>"))))
    known = F.coalesce(F.try_element_at(table, col(script)), F.array().cast("array<string>"))
    usable = F.slice(F.filter(known, lambda c: (F.size(installed) == 0) | F.array_contains(installed, c)), 1, most)
    return F.when(F.size(usable) > 0, F.array_join(usable, "+")).otherwise(F.lit(FALLBACK))


def usable(script) -> Column:
    """Whether any language is known for a script."""
    return F.coalesce(col(script).isin(*SUFFIXES), F.lit(False))


def compatible(first, second) -> Column:
    """Whether two script names are read with one language: Han of either kind is one, and goes with Japanese."""
    a, b = (F.when(col(x).isin("HanS", "HanT"), F.lit("Han")).otherwise(col(x)) for x in (first, second))
    return (a == b) | (a.isin("Han", "Japanese") & b.isin("Han", "Japanese"))


def trustworthy(claimed, printed, confidence) -> Column:
    """Whether a page's text may be what is printed: where either script is unknown or the reading unsure, it may."""
    unknown = (F.coalesce(col(claimed), F.lit("")) == "") | (F.coalesce(col(printed), F.lit("")) == "")
    return unknown | F.coalesce(col(confidence) < LEAST_CONFIDENCE, F.lit(True)) | compatible(printed, claimed)
