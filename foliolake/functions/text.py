"""Text rules as column expressions.

Patterns name their classes in full, since Java's and other engines' short
classes differ: WS is all Unicode white space, LETTER any letter-like sign.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: patterns and signs that must be the same for the same results
WS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
LETTER = r"[\p{L}\p{Nl}\p{No}]"
#: Hiragana, katakana, and the two Han blocks of ordinary text.
CJK = r"[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}]"
LEADERS = rf"{WS}*(?:\.{WS}*){{4,}}"
TERMINATOR = rf"(?:[.!?…][\"'”’)\]]*{WS}+|[。！？][\"'”』】)\]]*)"
#: All that WS holds, sign by sign.
WS_SIGNS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
SENTENCE = rf"(?s)(.+?(?:{TERMINATOR}|\z))"

# fixed values: words whose full stop ends no sentence
ABBREVIATIONS = (
    "approx", "bzw", "ca", "cf", "d.h", "dept", "dr", "e.g", "env", "etc", "evtl", "fig", "fr", "geb", "gest", "ggf", "hr", "i.e", "inkl", "mlle", "mme", "mr", "mrs", "ms", "mwst",
    "no", "nr", "prof", "sog", "sr", "sra", "srta", "st", "str", "tel", "u.a", "u.u", "ud", "uds", "usw", "vol", "vs", "z.b", "z.zt", "zzgl",
)
# fixed values: presentation forms of ligatures, and capitals that stand for ligatures after a small letter
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
MISMAPPED = {"Ɵ": "ti", "Ʃ": "tt", "Ō": "ft"}
SMALL = "[a-zà-öø-ÿ]"
WIKI = r"==|\[\[|\]\]|\{\{|\}\}"
MARKER = rf"(?s)^({WS}*(?:#{{1,6}}{WS}+|[-*+]{WS}+|\p{{Nd}}+[.)]{WS}+|>{WS}*)?)(.*)$"
ROMAN = r"(?i)^m{0,4}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})\.?$"
ADDRESS = rf"(?i)^(?:https?://|www\.)[^\s]+$"

#: Scripts and their classes, in the order that breaks ties.
SCRIPTS = {
    "Latin": r"\p{IsLatin}", "Cyrillic": r"\p{IsCyrillic}", "Greek": r"\p{IsGreek}", "Arabic": r"\p{IsArabic}", "Hebrew": r"\p{IsHebrew}", "Han": r"\p{IsHan}", "Kana": r"[\p{IsHiragana}\p{IsKatakana}]", "Hangul": r"\p{IsHangul}",
}


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x) -> Column:
    """Without white space at both ends; all Unicode white space counts."""
    return F.btrim(col(x), F.lit(WS_SIGNS))


def without_leaders(x) -> Column:
    """Dotted leaders as a space; texts without four dots are only counted."""
    t = col(x)
    dots = F.length(t) - F.length(F.replace(t, F.lit("."), F.lit("")))
    return F.when(dots >= 4, F.regexp_replace(t, LEADERS, " ")).otherwise(t)


def blank(x) -> Column:
    """Whether ``strip`` leaves nothing; the search ends at the first other character."""
    return ~col(x).rlike("[^" + WS[1:])


def squeeze(x) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(col(x), rf"{WS}+", " "))


def count(x, pattern: str) -> Column:
    return F.regexp_count(col(x), F.lit(pattern)).cast("long")


def translatable(x) -> Column:
    """Whether a text holds words: two letters in a row or two CJK signs, and isn't an address or a roman number."""
    t = strip(without_leaders(x))
    odd = t.rlike(ADDRESS) | (t.rlike(ROMAN) & (t != ""))
    return (t.rlike(LETTER + "{2}") | t.rlike(f"(?s){CJK}.*{CJK}")) & ~odd


def clean(x) -> Column:
    """Leaders to a space, private signs to a bullet, curly quotes to straight, spaced dashes to hyphens, stripped."""
    t = F.regexp_replace(without_leaders(x), r"[\x{E000}-\x{F8FF}]", "•")
    return strip(F.regexp_replace(F.translate(t, "“”", '""'), rf"(?<={WS})[—–](?={WS})", "-"))


def restore_dashes(source, out) -> Column:
    """The source's spaced dash in place of hyphens, unless it had spaced hyphens too."""
    dash = F.regexp_extract(col(source), rf"{WS}([—–])(?={WS})", 1)
    keep = (dash == "") | F.contains(col(source), F.lit(" - "))
    return F.when(keep, col(out)).otherwise(F.replace(col(out), F.lit(" - "), F.concat(F.lit(" "), dash, F.lit(" "))))


def space_after_stops(x) -> Column:
    return F.regexp_replace(col(x), r"([.!?])(?=[A-ZÄÖÜ])", "$1 ")


def ligatures(x, small: bool = False) -> Column:
    """Ligatures as letters; ``small`` also mends i-tilde between small letters."""
    t = col(x)
    for sign, letters in LIGATURES.items():
        t = F.replace(t, F.lit(sign), F.lit(letters))
    for sign, letters in MISMAPPED.items():
        t = F.regexp_replace(t, f"(?<={SMALL}){sign}", letters)
    return F.regexp_replace(t, f"(?<={SMALL})ĩ(?={SMALL})", "fb") if small else t


def weighted_length(x) -> Column:
    """Length, with CJK signs counting two and a half."""
    return F.length(col(x)) + 1.5 * count(x, CJK)


def guard(source, out, target=None) -> Column:
    """``out``, or ``source`` where it is too long, has new wiki markup, or new CJK for a target without."""
    s, o = col(source), col(out)
    t = F.coalesce(col(target), F.lit("")) if target is not None else F.lit("")
    grown = F.length(o) > 2.0 * weighted_length(s) + 15
    markup = o.rlike(WIKI) & ~s.rlike(WIKI)
    cjk = o.rlike(CJK) & ~s.rlike(CJK) & ~(t.startswith("zho") | t.startswith("jpn"))
    return F.when(grown | markup | cjk, s).otherwise(o)


def letter_share(x) -> Column:
    """Letters among visible characters, 0 if none are visible."""
    return F.coalesce(F.try_divide(count(x, r"\p{L}").cast("double"), (F.length(col(x)) - count(x, WS)).cast("double")), F.lit(0.0))


def pieces(x) -> Column:
    """Candidate sentences; together they are the input."""
    return F.regexp_extract_all(col(x), F.lit(SENTENCE), F.lit(1))


def ends_in_abbreviation(piece) -> Column:
    before = F.regexp_replace(col(piece), TERMINATOR + "$", "")
    word = F.regexp_extract(before, r"(\S+)$", 1)
    bare = F.lower(F.regexp_replace(F.regexp_replace(word, r"^[.,;:!?\"'()\[\]“”„»«]+", ""), r"[.,;:!?\"'()\[\]“”„»«]+$", ""))
    return F.coalesce(bare.isin(*ABBREVIATIONS), F.lit(False))


def _goes_on(piece: Column, before: Column) -> Column:
    """Whether the word at the end of a piece begins in the piece before it, whose last sign is then no white space."""
    return F.coalesce(before.rlike("[^" + WS[1:] + r"\z"), F.lit(False)) & ~F.regexp_replace(piece, TERMINATOR + r"\z", "").rlike(WS)


def sentences(x) -> Column:
    """array<string>: pieces, joined where the first ends in an abbreviation; blank ones dropped.

    Blank input is its own only piece.
    """
    def cut(p: Column) -> Column:
        n = F.size(p)
        open_ = F.transform(p, lambda s, i: ends_in_abbreviation(s) & ~_goes_on(s, F.get(p, i - 1)))
        ends = F.get(F.transform(F.array(open_), lambda o: F.filter(F.sequence(F.lit(0), n - 1), lambda i: ~F.get(o, i) | (i == n - 1))), F.lit(0))
        return F.get(F.transform(F.array(ends), lambda e: F.transform(e, lambda z, j: F.array_join(F.slice(p, F.coalesce(F.get(e, j - 1) + 2, F.lit(1)), z - F.coalesce(F.get(e, j - 1), F.lit(-1))), ""))), F.lit(0))

    made = F.get(F.transform(F.array(pieces(x)), lambda p: F.when(F.size(p) > 0, cut(p)).otherwise(F.array().cast("array<string>"))), F.lit(0))
    kept = F.filter(made, lambda s: ~blank(s))
    return F.when(blank(x), F.array(col(x))).otherwise(kept)


def marker(line) -> Column:
    return F.regexp_extract(col(line), MARKER, 1)


def unmarked(line) -> Column:
    return F.regexp_extract(col(line), MARKER, 2)


def is_fence(line) -> Column:
    return strip(line).rlike(r"^(```|~~~)")


def join_syllables(x) -> Column:
    """Sung text as words: hyphens between letters go, underscores become spaces."""
    return F.regexp_replace(F.regexp_replace(col(x), rf"(?<={LETTER}){WS}*-{WS}*(?={LETTER})", ""), "_+", " ")


# fixed values: what a spreadsheet cell holds that is no text: a number, an IPv4 address or block, a range of them, a MAC address
NOT_TEXT = (r"-?\d+([.,]\d+)?", r"(\d{1,3}\.){3}\d{1,3}(/\d{1,2})?", r"(\d{1,3}\.){3}\d{1,3}\s*-\s*(\d{1,3}\.){3}\d{1,3}", r"([0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}")


def plain_cell(x) -> Column:
    """Whether a spreadsheet cell is text: not blank and none of NOT_TEXT."""
    t = strip(x)
    return (t != "") & ~t.rlike("^(?:" + "|".join(NOT_TEXT) + ")$")


def script(x) -> Column:
    """The commonest script, the first of SCRIPTS at a tie; empty if there is none."""
    n = [F.struct(count(x, p).alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("s")) for i, (name, p) in enumerate(SCRIPTS.items())]
    best = F.array_max(F.array(*n))
    return F.when(best["n"] > 0, best["s"]).otherwise(F.lit(""))


def first_script(x) -> Column:
    """The script, other than Latin, of the first character that has one; empty if none has."""
    at = [F.struct(F.nullif(F.regexp_instr(col(x), F.lit(p)), F.lit(0)).alias("at"), F.lit(name).alias("s")) for name, p in SCRIPTS.items() if name != "Latin"]
    return F.coalesce(F.array_min(F.filter(F.array(*at), lambda a: a["at"].isNotNull()))["s"], F.lit(""))


def right_to_left(x) -> Column:
    n = count(x, r"[\x{0590}-\x{08FF}\x{FB1D}-\x{FDFF}\x{FE70}-\x{FEFF}]")
    return (n > 0) & (2 * n > count(x, r"\p{L}"))


def dot_leader(word) -> Column:
    """Whether an OCR word is a dotted leader: only dots, four in a row, or long and made of hardly two letters."""
    w = F.lower(col(word))
    chars = F.filter(F.split(w, ""), lambda c: c != "")
    counts = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda d: d == c)))
    two = F.aggregate(F.slice(F.sort_array(counts, asc=False), 1, 2), F.lit(0), lambda a, b: a + b)
    return w.rlike(r"^[.·…]{2,}$") | w.rlike(r"[.·…]{4,}") | ((F.length(w) >= 12) & (two >= 0.7 * F.length(w)))


def direction(x) -> Column:
    """A score's stage direction: five words and no syllable marks."""
    return (count(x, LETTER + "{2,}") >= 5) & ~col(x).rlike(rf"{LETTER}{WS}*-{WS}*{LETTER}|_")


def score_junk(word, conf) -> Column:
    letters = count(word, r"\p{L}")
    return F.when(letters == 0, ~col(word).rlike(r"^[-_—–]+$")).otherwise((letters <= 2) & (col(conf) < 50))


# fixed values: parts of the names of serif fonts
SERIFS = ("serif", "times", "georgia", "garamond", "cambria", "palatino", "book", "roman", "minion", "baskerville", "constantia", "charter", "century")


def serif(font) -> Column:
    name = F.lower(col(font))
    return name.rlike("|".join(SERIFS)) & ~F.contains(name, F.lit("sans"))


def column_name(ref) -> Column:
    return F.regexp_replace(F.upper(col(ref)), "[^A-Z]", "")


def column_index(name) -> Column:
    """Base 26, from A = 1."""
    letters = F.filter(F.split(col(name), ""), lambda c: c != "")
    return F.aggregate(letters, F.lit(0).cast("long"), lambda a, c: a * 26 + F.ascii(c) - 64)


def unquoted(x) -> Column:
    """A quoted gettext string as text."""
    got = F.from_json(F.concat(F.lit('{"v":'), col(x), F.lit("}")), "v string")["v"]
    return F.coalesce(got, F.regexp_replace(F.regexp_replace(col(x), '^"+', ""), '"+$', ""))


def quoted(x) -> Column:
    return F.regexp_extract(F.to_json(F.struct(col(x).alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)


def model_input(model_id, text, target) -> Column:
    """Text with its target's sign, for models of many languages."""
    sign = F.concat(F.lit(">>"), F.substring_index(col(target), "_", 1), F.lit("<< "))
    return F.when(F.contains(F.lower(col(model_id)), F.lit("mul-mul")), F.concat(sign, col(text))).otherwise(col(text))


def local_time(created, zone) -> Column:
    """ISO time in UTC as local time; null if malformed."""
    return F.from_utc_timestamp(F.try_to_timestamp(col(created)), zone)
