"""Personal data: generators propose spans, boosted trees choose among them.

Base spans follow fixed formats and always stay. High-recall generators
propose more in the text that base spans leave: addresses with spelled-out
signs, and runs of digits, as wide and as evenly set as they go; proposals of
the last two overlap. Boosted trees over format and context score each
proposal for each kind; of those above their kind's calibrated threshold that
touch one another the best is added.

Targets of the trees are none of the base patterns' own: base spans of a
bounded sample are written in other ways (positives), and spoiled or replaced
by look-alikes (dates, versions, serial numbers, prose with "at"; negatives),
each in the words around it. Thresholds are calibrated by kind on a fold of
the sample that the trees have not seen. All work on rows is in column
expressions, with nothing shuffled; only spans of the sample and their
features reach the driver, where the trees are grown.

Work on a text grows in proportion to its length and, up to tables of sums
by blocks, to its spans.

Inputs: a null text is empty; a text without spans has counts 0 and the hash
of the empty string; very long texts are read whole; positions are code
points, ends exclusive; of proposals that tie the first, then the longer one
is added; repeated rows each have their own result; an empty table gives an
empty result, and trees learnt from made spans alone. Columns named
``__fl_...`` are the operator's; others, whatever their names, pass through.
"""

import random
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table
from .quality import Forest, grow

KINDS = ("email", "ip", "card", "phone")

# The base formats. Possessive quantifiers and the look-behinds change no
# match: they only spare attempts that can't succeed, so that long runs of
# one class cost linear time.
_LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Stands where base spans were while generators look for more; no class of theirs holds it.
_GONE = "\ufffe"
# fixed values: spellings of the signs in an address
_AT = r"(?:\x20?[\[({<]\x20?(?:at|AT|At|@)\x20?[\])}>]\x20?|\x20(?:at|AT|At)\x20)"
_DOT = r"(?:\x20?[\[({<]\x20?(?:dot|DOT|Dot|\.)\x20?[\])}>]\x20?|\x20(?:dot|DOT|Dot)\x20)"
#: Wide generators, and the kinds that their proposals may be.
WIDE = {
    "address": (rf"(?<![{_LOCAL}{_GONE}])[{_LOCAL}]++(?:@|{_AT})[A-Za-z0-9-]++(?:(?:\.|{_DOT})[A-Za-z0-9-]++)++(?!{_GONE})", ("email",)),
    "run": (rf"(?<![0-9A-Za-z{_GONE}])(?:\+?+\(?+)[0-9]++(?:[\x20().\-/_\[\]]{{1,3}}+[0-9]++)*+(?![0-9A-Za-z{_GONE}])", ("ip", "card", "phone")),
    "even": (rf"(?<![0-9A-Za-z{_GONE}])(?:\([0-9]++\)\x20?+)?+[0-9]++(?:([\x20.\-/])[0-9]++(?:\1[0-9]++)*+)?+(?![0-9A-Za-z{_GONE}])", ("ip", "card", "phone")),
}
#: Documents whose spans are learnt from (about; by a bound on the hash of the text), spans of them, spans made where a kind has fewer, and the trees.
SAMPLE_DOCS, SAMPLE_SPANS, MADE, TREES, DEPTH = 65_536, 8_000, 400, 20, 3
#: Least threshold, and the precision that a threshold must reach on the unseen fold.
LEAST, PRECISION = 0.8, 0.98
CONTEXT = 24
#: Digits of a number that can be personal data.
FEWEST, MOST = 7, 19
#: Code points of a block when a text is cut at many places.
_BLOCK = 256
# fixed values: words around a proposal that tell its kind
HINTS = {
    "email": "mail|contact|write|adress|address|correo|courriel", "ip": "ip|host|server|addr|gateway|dns|subnet",
    "card": "card|visa|master|amex|credit|debit|payment|karte|carte|tarjeta", "phone": "phone|tel|call|mobile|cell|fax|whatsapp|handy|portable",
}
# fixed values: common last parts of an address, and words that stand before "at" in prose
_ENDS = "com|org|net|edu|gov|info|io|eu|de|fr|es|it|uk|us|example"
_PROSE = "look|looked|be|was|is|are|were|am|me|us|it|here|there|work|works|live|lives|read|more|see|and|or|up|out|only|even|available|online|hosted|found|published|shop|stay|meet|arrive|a|i|the"


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    """body(x) with x worked out once, however often the body uses it."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def _span(start: Column, kind: Column, end: Column) -> Column:
    # aliases within lambdas are lost, so fields are named by literals
    return F.named_struct(F.lit("start"), start, F.lit("kind"), kind, F.lit("end"), end)


_SPANS = "array<struct<start:int,kind:int,end:int>>"


def _scan(values: Column, fold: Callable[[Column], Column], join: Callable[[Column, Column], Column]) -> Column:
    """``fold`` of all elements up to and with each, by blocks of 64 whose own folds are worked out once."""
    def over(e: Column) -> Column:
        n = F.size(e)
        blocks = F.transform(F.sequence(F.lit(0), ((n - 1) / 64).cast("int")), lambda b: fold(F.slice(e, b * 64 + 1, F.lit(64))))
        before = let(blocks, lambda by: F.transform(by, lambda x, b: F.when(b > 0, fold(F.slice(by, F.lit(1), b)))))

        def at(by: Column) -> Column:
            return F.transform(F.sequence(F.lit(1), n), lambda k: let(((k - 1) / 64).cast("int"), lambda b: let(
                fold(F.slice(e, b * 64 + 1, k - b * 64)), lambda here: F.when(b > 0, join(F.get(by, b), here)).otherwise(here),
            )))

        return let(before, at)

    return let(values, lambda e: F.when(F.size(e) > 0, over(e)).otherwise(F.array().cast("array<int>")))


def prefix_sums(lengths: Column) -> Column:
    """Sums up to and with each element."""
    return _scan(lengths, lambda x: F.aggregate(x, F.lit(0), lambda a, b: a + b), lambda a, b: a + b)


def matches(text: Column, pattern: str, worth: Column) -> Column:
    """array<struct<start, end, s, before, after>> of leftmost matches, where ``worth`` holds; else empty.

    before and after: what stands around, up to the next match.
    """
    def placed(found: Column) -> Column:
        return let(F.split(text, pattern, -1), lambda g: let(
            prefix_sums(F.transform(found, lambda m, i: F.length(F.get(g, i)) + F.coalesce(F.length(F.get(found, i - 1)), F.lit(0)))),
            lambda at: F.transform(found, lambda m, i: F.named_struct(
                F.lit("start"), F.get(at, i), F.lit("end"), F.get(at, i) + F.length(m), F.lit("s"), m,
                F.lit("before"), F.right(F.get(g, i), F.lit(CONTEXT)), F.lit("after"), F.left(F.coalesce(F.get(g, i + 1), F.lit("")), F.lit(CONTEXT)),
            )),
        ))

    none = F.array().cast("array<struct<start:int,end:int,s:string,before:string,after:string>>")
    return F.when(worth, let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, placed(found)).otherwise(none))).otherwise(none)


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]+", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits passes Luhn's test."""
    def one(i: Column) -> Column:
        return let(F.substring(d, F.length(d) - i, F.lit(1)).cast("int") * (F.lit(1) + i % 2), lambda v: F.when(v > 9, v - 9).otherwise(v))
    return F.aggregate(F.transform(F.sequence(F.lit(0), F.length(d) - 1), one), F.lit(0), lambda a, b: a + b) % 10 == 0


def _small(part: Column) -> Column:
    """Whether a decimal number of any length is 255 at most."""
    return let(F.regexp_replace(part, "^0+(?=.)", ""), lambda p: F.when(F.length(p) <= 3, p.cast("int") <= 255).otherwise(False))


def valid(kind: str, s: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(s, "\\."), _small)
    low, high = (12, 19) if kind == "card" else (9, 15)
    return let(digits(s), lambda d: F.when(F.length(d).between(low, high), luhn(d) if kind == "card" else F.lit(True)).otherwise(False))


def _worth(kind: str, text: Column) -> Column:
    if kind in ("email", "address"):
        return F.contains(text, F.lit("@")) | (text.rlike("[\\[({<\\x20](?:at|AT|At)[\\])}>\\x20]") if kind == "address" else F.lit(False))
    if kind == "phone":
        return F.contains(text, F.lit("+"))
    return text.rlike("[0-9]")


def base(text: Column) -> Column:
    """array<struct<start, kind, end>> of base spans by start, then kind."""
    by = []
    for i, kind in enumerate(KINDS):
        good = F.filter(matches(text, BASE[kind], _worth(kind, text)), lambda m: valid(kind, m["s"]))
        by.append(F.transform(good, lambda m: _span(m["start"], F.lit(i), m["end"])))
    return F.array_sort(F.concat(*by))


def _count(s: Column, pattern: str) -> Column:
    return F.regexp_count(s, F.lit(pattern)).cast("double")


def _yes(c: Column) -> Column:
    return c.cast("double")


def address_features(m: Column) -> list[Column]:
    """Of the plain spelling: the parts around the signs; and how the signs are spelled."""
    plain = F.regexp_replace(F.regexp_replace(m["s"], _AT, "@"), _DOT, ".")
    local, domain = F.substring_index(plain, "@", 1), F.substring_index(plain, "@", -1)
    last = F.substring_index(domain, ".", -1)
    before, after = F.lower(m["before"]), F.lower(m["after"])
    return [
        F.length(local).cast("double"), F.length(domain).cast("double"), _count(domain, "\\."), F.length(last).cast("double"), _yes(last.rlike("^[A-Za-z]+$")), _yes(last.rlike("[0-9]")),
        _yes(local.rlike("^[A-Za-z0-9]")), _count(local, "[0-9._%+-]"), _yes(F.lower(local).rlike(f"^(?:{_PROSE})$")), _yes(F.lower(last).rlike(f"^(?:{_ENDS})$")),
        _yes(m["s"].rlike("[\\[({<]")), _count(m["s"], "(?i)\\bdot\\b"), _yes(before.rlike(HINTS["email"])), _yes(after.rlike("^[a-z0-9]")), _yes(before.rlike("[a-z,] $")),
    ]


def digit_features(m: Column) -> list[Column]:
    """Of the grouping and the checks, without the sign in front."""
    s = m["s"]
    groups, d = F.split(F.regexp_replace(s, "^[^0-9]+", ""), "[^0-9]+"), digits(s)
    size = F.transform(groups, lambda g: F.length(g))
    before, after = F.lower(m["before"]), F.lower(m["after"])
    four = F.size(groups) == 4
    return [
        F.length(d).cast("double"), F.size(groups).cast("double"), F.get(size, F.lit(0)).cast("double"), F.get(size, F.lit(1)).cast("double"), F.element_at(size, -1).cast("double"), F.array_max(size).cast("double"), F.array_min(size).cast("double"),
        _count(s, "\\."), _count(s, "-"), _count(s, " "), _count(s, "[()]"), _count(s, "/"), _count(s, "[_\\[\\]]"), _yes(s.rlike("^\\+?\\(")), _yes(s.rlike("^0")), _yes(s.rlike("^00")),
        _yes(F.when(four, F.forall(groups, _small)).otherwise(False)), _yes(F.forall(size, lambda n: n == 4)), _yes(F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False)),
        _yes(s.rlike("^(?:19|20)[0-9]{2}[-/. ](?:0?[1-9]|1[0-2])[-/. ]")), _yes(s.rlike("^(?:0?[1-9]|[12][0-9]|3[01])[-/. ](?:0?[1-9]|1[0-2])[-/. ](?:19|20)[0-9]{2}")), _yes(s.rlike("^97[89][- ]?[0-9]")),
        *(_yes(before.rlike(HINTS[k])) for k in ("ip", "card", "phone")), _yes(after.rlike("^[a-z]")), _yes(before.rlike("[#$%&=/:.,]\\s?$")), _yes(after.rlike("^[%$:,]")),
    ]


FEATURES = {"address": address_features, "run": digit_features, "even": digit_features}


def _group(generator: str) -> str:
    return "address" if generator == "address" else "digits"


def _likely(generator: str, m: Column) -> Column:
    """Which proposals are worth features: any address, and numbers with as many digits or groups as personal data."""
    if generator == "address":
        return F.lit(True)
    return let(F.regexp_count(m["s"], F.lit("[0-9]")), lambda n: n.between(FEWEST, MOST) | ((n >= 4) & (n <= 12) & (F.regexp_count(m["s"], F.lit("[0-9]+")) == 4)))


def proposals(text: Column, generator: str) -> Column:
    """array<struct<start, end, x>> of a generator's spans and their features."""
    made = FEATURES[generator]
    some = F.filter(matches(text, WIDE[generator][0], _worth(generator, text)), lambda m: _likely(generator, m))
    return F.transform(some, lambda m: F.named_struct(F.lit("start"), m["start"], F.lit("end"), m["end"], F.lit("x"), F.array(*made(m))))


def blocks(text: Column) -> Column:
    """A text in pieces of _BLOCK code points, from which ``cut`` takes any stretch without a walk from the start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0))


def cut(pieces: Column, start: Column, end: Column) -> Column:
    first = (start / _BLOCK).cast("int")
    some = F.array_join(F.slice(pieces, first + 1, F.greatest(((end - 1) / _BLOCK).cast("int") - first + 1, F.lit(0))), "")
    return F.when(end > start, F.substring(some, start % _BLOCK + 1, end - start)).otherwise(F.lit(""))


def merged(spans: Column) -> Column:
    """Sorted spans, those that overlap as one, of the kind of the first."""
    def over(s: Column, reach: Column) -> Column:
        heads = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (x["start"] >= F.get(reach, i - 1)), i)), lambda i: i.isNotNull())
        return let(heads, lambda h: F.transform(h, lambda i, j: _span(F.get(s, i)["start"], F.get(s, i)["kind"], F.get(reach, F.coalesce(F.get(h, j + 1), F.size(s)) - 1))))

    return let(spans, lambda s: let(_scan(F.transform(s, lambda x: x["end"]), F.array_max, F.greatest), lambda reach: over(s, reach)))


def replaced(text: Column, spans: Column, by: Callable[[Column], Column]) -> Column:
    """``text`` with each of the spans, which lie apart and in order, replaced by ``by`` of it."""
    def over(pieces: Column, s: Column) -> Column:
        parts = F.transform(s, lambda x, i: F.concat(cut(pieces, F.coalesce(F.get(s, i - 1)["end"], F.lit(0)), x["start"]), by(x)))
        return F.concat(F.array_join(parts, ""), cut(pieces, F.element_at(s, -1)["end"], F.length(text)))

    return F.when(F.size(spans) > 0, let(spans, lambda s: let(blocks(text), lambda pieces: over(pieces, s)))).otherwise(text)


def without(text: Column, spans: Column) -> Column:
    """``text`` of the same length with the spans blotted out."""
    return replaced(text, merged(spans), lambda x: F.repeat(F.lit(_GONE), x["end"] - x["start"]))


@dataclass
class Model:
    """Trees and threshold by kind, and what they reach on the unseen fold: (precision, recall, positives)."""

    forests: dict[str, Forest]
    thresholds: dict[str, float]
    report: dict[str, tuple[float, float, int]] = field(default_factory=dict)


def threshold(score: np.ndarray, y: np.ndarray, precision: float = PRECISION, least: float = LEAST) -> float:
    """Half way from the least score down to which the precision holds to the next; above 1, so nothing passes, if it never does."""
    order = np.argsort(-score, kind="stable")
    right, s = np.cumsum(y[order]), score[order]
    good = [i for i in range(len(s)) if right[i] >= precision * (i + 1) and (i + 1 == len(s) or s[i + 1] < s[i])]
    if not good:
        return 1.1
    return max(least, float(s[good[-1]] + s[min(good[-1] + 1, len(s) - 1)]) / 2)


def _digits_of(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def _split(s: str, sizes: tuple[int, ...], by: str) -> str:
    at = np.cumsum([0, *sizes])
    return by.join(s[a:b] for a, b in zip(at, at[1:], strict=False))


def _made(kind: str, rng: random.Random) -> str:
    """A plain span of a kind, for corpora that have few of their own."""
    if kind == "email":
        name = "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randrange(3, 9)))
        return f"{name}{rng.choice(['', '.' + name[::-1], str(rng.randrange(99))])}@{name[::-1]}.{rng.choice(_ENDS.split('|'))}"
    if kind == "ip":
        return ".".join(str(rng.randrange(256)) for _ in range(4))
    if kind == "phone":
        return f"+{rng.choice(['1', '44', '49', '33'])} {_digits_of(rng, 3)} {_digits_of(rng, 3)} {_digits_of(rng, 4)}"
    d = "4" + _digits_of(rng, 14)
    return next(d + c for c in "0123456789" if sum(sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(reversed(d + c))) % 10 == 0)


def written_otherwise(kind: str, s: str, rng: random.Random) -> str:
    """A span of personal data in another spelling than the base format's: a positive."""
    d = "".join(c for c in s if c in "0123456789")
    if kind == "email":
        local, _, domain = s.partition("@")
        at = rng.choice([" [at] ", "[at]", " (at) ", "(at)", "{at}", " at ", " AT ", "[@]", " [AT] "])
        dot = rng.choice([".", ".", " dot ", "[dot]", " [dot] ", "(dot)", "[.]"])
        return local + at + domain.replace(".", dot)
    if kind == "ip":
        return rng.choice(["[.]", "(.)", " . ", "[.]"]).join(s.split("."))
    if kind == "card":
        d = (d + _digits_of(rng, 16))[:16]
        by = rng.choice(["-", " ", ".", "/", " - ", "_", "mixed", "typo"])
        if by == "typo":  # one digit wrong, still set like a card
            i = rng.randrange(16)
            return _split(d[:i] + str((int(d[i]) + rng.randrange(1, 10)) % 10) + d[i + 1 :], (4, 4, 4, 4), rng.choice("- "))
        return f"{d[:4]}-{d[4:8]} {d[8:12]} {d[12:]}" if by == "mixed" else _split(d, (4, 4, 4, 4), by)
    ten = (d[-10:] + _digits_of(rng, 10))[:10]
    area, rest = ten[:3], ten[3:]
    return rng.choice([
        f"({area}) {rest[:3]}-{rest[3:]}", f"{area}-{rest[:3]}-{rest[3:]}", f"{area}.{rest[:3]}.{rest[3:]}", f"001 {area} {rest[:3]} {rest[3:]}", f"1-{area}-{rest[:3]}-{rest[3:]}", f"0{area}/{rest}",
        f"0{area[:2]} {rest[:4]} {rest[3:]}", f"(0{area[:2]}) {rest[:3]}-{_digits_of(rng, 6)}", f"0{area} {rest[:3]} {rest[3:]}", f"0{area[0]} {_split(_digits_of(rng, 8), (2, 2, 2, 2), ' ')}", f"0049 {area} {rest}",
    ])


def look_alike(kind: str, s: str, rng: random.Random) -> str:
    """What a span of personal data is easily taken for: a negative."""
    if kind == "email":
        domain = s.partition("@")[2] or "site.org"
        return rng.choice([
            f"{rng.choice(_PROSE.split('|'))} at {domain}", f"{rng.choice(_PROSE.split('|'))} at {_digits_of(rng, 1)}.{_digits_of(rng, 2)}", f"{rng.choice(_PROSE.split('|'))} at {domain.split('.')[0]}.And",
            f"{rng.choice(_PROSE.split('|'))} at {domain.split('.')[0]} dot {rng.choice(['and', 'it', 'the'])}", f"v{_digits_of(rng, 1)} at {_digits_of(rng, 1)}.{_digits_of(rng, 1)}",
        ])
    if kind == "ip":
        parts = [str(rng.randrange(256)) for _ in range(4)]
        parts[rng.randrange(4)] = str(rng.randrange(256, 1000))
        return rng.choice([".".join(parts), "[.]".join(parts), ".".join(str(rng.randrange(30)) for _ in range(5)), " ".join(str(rng.randrange(100)) for _ in range(4)), "-".join(str(rng.randrange(20)) for _ in range(4)), "/".join(str(rng.randrange(200)) for _ in range(4))])
    if kind == "card":
        d = _digits_of(rng, 16)
        return rng.choice([_digits_of(rng, rng.randrange(8, 20)), _split(d, (3, 5, 4, 4), "-"), _split(d, (2, 6, 8), " "), _split("978" + d, (3, 1, 2, 6, 1), "-"), _split(d, (4, 4, 4), "-"), ", ".join(f"{y}-{y + 4}" for y in (rng.randrange(1900, 1960), rng.randrange(1960, 2020))), f"{d[:3]}.{d[3:12]}", _split(d, (1, 3, 3, 3, 3), " ")])
    year, month, day = rng.randrange(1900, 2030), rng.randrange(1, 13), rng.randrange(1, 29)
    return rng.choice([
        f"{year}-{month:02}-{day:02}", f"{day:02}.{month:02}.{year}", f"{month:02}/{day:02}/{year}", f"{year}-{month:02}-{day:02} {rng.randrange(24):02}", f"{year}/{month:02}/{day:02}", f"{year}-{year + 3} {year + 9}",
        f"{rng.randrange(1, 99)} {_digits_of(rng, 3)} {_digits_of(rng, 3)}", _digits_of(rng, rng.randrange(7, 12)), f"{rng.randrange(10)}.{_digits_of(rng, rng.randrange(6, 11))}", _split(_digits_of(rng, 9), (3, 2, 4), "_"), f"{_digits_of(rng, 7)}/{_digits_of(rng, 2)}",
        f"{_digits_of(rng, 6)} - {_digits_of(rng, 6)}", _split(_digits_of(rng, 12), (1, 5, 5, 1), " "), f"{_digits_of(rng, 5)} {_digits_of(rng, 5)} {_digits_of(rng, 5)}",
    ])


def _sampled(docs: DataFrame, n_docs: int, most: int) -> list[tuple]:
    """(h, kind, s, before, after) of base spans of about ``n_docs`` documents, by a bound on the hash of the text; ``most`` at most of each kind."""
    n = docs.count()
    text = F.coalesce("text", F.lit(""))
    some = docs.select(text.alias("text"), F.xxhash64(F.lit("pii"), text).alias("h"))
    if n > n_docs:
        some = some.where(F.abs(F.col("h").cast("double")) < 2.0**63 * n_docs / n)
    out = []
    for kind in KINDS:
        good = F.filter(matches(F.col("text"), BASE[kind], _worth(kind, F.col("text"))), lambda m: valid(kind, m["s"]))
        spans = some.select("h", F.explode(good).alias("m")).select("h", "m.s", "m.before", "m.after", "m.start")
        got = spans.orderBy("h", "start", "s").limit(most).collect()  # ``most`` rows of a few words at most
        out += [(r["h"], kind, r["s"], r["before"], r["after"]) for r in got]
    return out


def exercises(seeds: list[tuple], made: int = MADE) -> list[tuple[int, str, int, int, str]]:
    """(h, kind, start, end, text): spans written otherwise with their kind, and look-alikes with none, each in a seed's words.

    Kinds with fewer than ``made`` seeds get made ones, in the words of others.
    """
    rng = random.Random(20_11)
    words = [(b, a) for _, _, _, b, a in seeds] or [("", ""), ("write to ", " today"), ("call ", "."), ("the server ", " is"), ("paid by card ", ", thank you")]
    tell = {"email": ["mail ", "contact: ", ""], "ip": ["host ", "server ", ""], "card": ["card ", "visa ", ""], "phone": ["phone ", "tel. ", "call ", ""]}
    other = ["page ", "no. ", "serial ", "", "", "in ", "since ", "id ", "order "]
    out = []
    for kind in KINDS:
        mine = [x for x in seeds if x[1] == kind]
        for k in range(made - len(mine)):
            b, a = rng.choice(words)
            mine.append((k, kind, _made(kind, rng), b, a))
        for h, _, s, b, a in mine:
            b, a = b.replace(_GONE, " "), a.replace(_GONE, " ")
            if b and not b[-1:].isspace():
                b += " "
            if a and a[:1].isalnum():
                a = " " + a
            for made_of, as_kind, hints in ((written_otherwise, kind, tell[kind]), (look_alike, "", other), (look_alike, "", other)):
                t = made_of(kind, s, rng)
                front = b + (rng.choice(hints) if rng.random() < 0.5 else "")
                out.append((h, as_kind, len(front), len(front) + len(t), front + t + a))
    return out


def fit(docs: DataFrame, n_docs: int = SAMPLE_DOCS, most: int = SAMPLE_SPANS, made: int = MADE) -> Model:
    """Trees and thresholds from exercises over the base spans of a bounded sample of ``docs``."""
    spark = docs.sparkSession
    rows = exercises(_sampled(docs, n_docs, most), made)
    given = spark.createDataFrame(rows, "h long, kind string, a int, z int, text string")
    forests, thresholds, report = {}, {}, {}
    x, y, seen, spot = ({"address": [], "digits": []} for _ in range(4))
    clean = given.withColumn("text", without(F.col("text"), base(F.col("text"))))
    for generator in WIDE:
        got = clean.select("h", "kind", "a", "z", F.explode(proposals(F.col("text"), generator)).alias("m")).where("m.start < z and m.end > a").select(
            "h", F.expr("case when m.start = a and m.end = z then kind else '' end").alias("kind"), "m.x",
        ).collect()  # a few rows for each of the exercises, whose number is bounded
        got.sort(key=lambda r: (r["h"], r["kind"], r["x"]))
        group = _group(generator)
        x[group] += [r["x"] for r in got]
        y[group] += [r["kind"] for r in got]
        seen[group] += [r["h"] % 4 != 0 for r in got]
    for group, kinds in (("address", ("email",)), ("digits", ("ip", "card", "phone"))):
        far, old = np.array(x[group], dtype=float), np.array(seen[group], dtype=bool)
        for k in kinds:
            right = np.array([kind == k for kind in y[group]], dtype=float)
            forests[k] = grow(far[old], right[old], trees=TREES, depth=DEPTH, rate=0.3, bins=32, least=5)
            score = forests[k].score(far[~old])
            thresholds[k] = threshold(score, right[~old])
            passed = score >= thresholds[k]
            report[k] = (float(right[~old][passed].mean()) if passed.any() else 1.0, float(passed[right[~old] == 1].mean()) if right[~old].any() else 0.0, int(right[~old].sum()))
    return Model(forests, thresholds, report)


def _margin(forest: Forest, x: Column) -> Column:
    """A forest as nested conditions."""
    depth = int(np.log2(forest.leaf.shape[1])) if len(forest.leaf) else 0

    def node(t: int, i: int) -> Column:
        if i >= 2**depth - 1:
            return F.lit(float(forest.leaf[t, i - (2**depth - 1)]))
        if not np.isfinite(forest.threshold[t, i]):
            return node(t, 2 * i + 1)
        return F.when(F.get(x, F.lit(int(forest.feature[t, i]))) > float(forest.threshold[t, i]), node(t, 2 * i + 2)).otherwise(node(t, 2 * i + 1))

    out = F.lit(float(forest.base))
    for t in range(len(forest.leaf)):
        out = out + node(t, 0)
    return out


def _best(chosen: Column) -> Column:
    """Of candidates (start, rank, end, kind) that touch, those before which none that touches them ranks.

    A candidate has MOST digits at most, so others that touch it lie within as
    many places on either side of it by start.
    """
    near = 2 * MOST

    def before(a: Column, b: Column) -> Column:
        return (a["start"] < b["end"]) & (b["start"] < a["end"]) & ((a["rank"] < b["rank"]) | (a["rank"] == b["rank"]) & ((a["start"] < b["start"]) | (a["start"] == b["start"]) & (a["end"] > b["end"])))

    # both generators may propose the same; array_distinct would compare all with all
    single = let(F.array_sort(chosen), lambda c: F.filter(c, lambda m, i: (i == 0) | ~m.eqNullSafe(F.get(c, i - 1))))
    return let(single, lambda c: F.filter(c, lambda m, i: ~F.exists(F.slice(c, F.greatest(i + 1 - near, F.lit(1)), F.lit(2 * near + 1)), lambda o: before(o, m))))


def _chosen(text: Column, generator: str, model: Model) -> Column:
    """array<struct<start, rank, end, kind>> of a generator's proposals, each as its best kind above its threshold."""
    def rated(m: Column) -> Column:
        cuts = {k: float(np.log(model.thresholds[k] / max(1e-12, 1 - model.thresholds[k]))) for k in WIDE[generator][1] if model.thresholds[k] <= 1}

        def as_kind(k: str) -> Column:
            return let(_margin(model.forests[k], m["x"]), lambda v: F.when(v >= cuts[k], F.named_struct(F.lit("rank"), -v, F.lit("kind"), F.lit(KINDS.index(k)))))

        each = [as_kind(k) for k in cuts]
        return F.array_min(F.filter(F.array(*each), lambda e: e.isNotNull()))

    scored = F.transform(proposals(text, generator), lambda m: let(rated(m), lambda e: F.named_struct(F.lit("start"), m["start"], F.lit("rank"), e["rank"], F.lit("end"), m["end"], F.lit("kind"), e["kind"])))
    return F.filter(scored, lambda m: m["rank"].isNotNull())


def listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _step(df: DataFrame, name: str, made: Column) -> DataFrame:
    """``df`` with a column that is worked out once, however often it is used: the explode keeps it apart."""
    return df.withColumn(name, F.explode(F.array(made)))


def detected(df: DataFrame, model: Model) -> DataFrame:
    """``df`` with __fl_base and __fl_all, the base spans and all spans of ``text`` by start, then kind."""
    def spans(c: Column) -> Column:
        return F.transform(c, lambda m: _span(m["start"], m["kind"], m["end"]))

    text, none = F.coalesce(F.col("text"), F.lit("")), F.array().cast(_SPANS)
    rows = _step(df, "__fl_base", base(text))
    # what base spans leave, where it may hold more
    rows = _step(rows, "__fl_rest", F.when(_worth("address", text) | _worth("run", text), without(text, F.col("__fl_base"))))
    open_ = {g: any(model.thresholds[k] <= 1 for k in kinds) for g, (_, kinds) in WIDE.items()}
    rows = _step(rows, "__fl_more", spans(_chosen(F.col("__fl_rest"), "address", model)) if open_["address"] else none)
    if open_["run"]:
        rows = _step(rows, "__fl_rest", without(F.col("__fl_rest"), F.col("__fl_more")))
        rows = _step(rows, "__fl_run", _chosen(F.col("__fl_rest"), "run", model))
        rows = _step(rows, "__fl_even", _chosen(F.col("__fl_rest"), "even", model))
        rows = _step(rows, "__fl_more", F.concat("__fl_more", spans(_best(F.concat("__fl_run", "__fl_even")))))
    return _step(rows, "__fl_all", F.array_sort(F.concat("__fl_base", "__fl_more"))).drop("__fl_rest", "__fl_more", "__fl_run", "__fl_even")


def redacted(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, with spans in ``text`` replaced by their kind in brackets.

    Of spans that overlap the first names the kind of all. n_chars follows
    the text.
    """
    rows = detected(docs, model or fit(docs))
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    out = rows.withColumn("text", F.when(F.size("__fl_all") > 0, replaced(F.col("text"), merged(F.col("__fl_all")), lambda x: F.get(names, x["kind"]))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op9: personal data in every document."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = detected(docs, fit(docs))
    counts = [F.size(F.filter("__fl_base", lambda s: s["kind"] == i)).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return rows.select("doc_id", *counts, F.sha2(listed(F.col("__fl_base")), 256).alias("base_sha256"), listed(F.col("__fl_all")).alias("spans"))
