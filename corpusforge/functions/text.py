"""Column functions on texts: they return Column and stay in the JVM."""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from functools import reduce
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusforge.config import LATIN, RUSSIAN_DEVOICED, RUSSIAN_STRESSED, RUSSIAN_UNSTRESSED, RUSSIAN_VOWELS, LanguageProfile

#: A word: letters, also after inner hyphens. Possessive, as Java's other loops over groups use stack for each hyphen.
WORD = r"\p{L}++(?:-\p{L}++)*+"

Text = Column | str


def _c(x: Text) -> Column:
    return F.col(x) if isinstance(x, str) else x


# Tokens, lines, sentences ----------------------------------------------------------


def tokens(text: Text, pattern: str = WORD) -> Column:
    """Words as written."""
    return F.regexp_extract_all(_c(text), F.lit(pattern), F.lit(0))


def lower_tokens(text: Text, pattern: str = WORD) -> Column:
    return tokens(F.lower(_c(text)), pattern)


def latin_first_tokens(text: Text, native: str = r"\p{IsCyrillic}") -> Column:
    """Native words with hyphens, where Latin letters may stand before the first hyphen only."""
    return tokens(text, rf"(?:[A-Za-z]+-)?{native}+(?:-{native}+)*|[A-Za-z]+")


def lines(text: Text) -> Column:
    return F.split(_c(text), "\n", -1)


def full_lines(text: Text) -> Column:
    """Lines that hold something else than white space."""
    return F.filter(lines(text), lambda x: F.trim(x) != "")


def sentences(text: Text, profile: LanguageProfile = LATIN) -> Column:
    """A text cut after . ! or ? where white space and an opener follow."""
    return F.split(_c(text), rf"(?<=[.!?])\s+(?={profile.openers})", -1)


def sentence_ends(text: Text) -> Column:
    """Sentence ends in verse: runs of marks, closing quotes or brackets, then white space or the end."""
    return F.regexp_count(_c(text), F.lit(r"[.!?…]+[»\"')]*(?=\s|$)"))


def syllables(line: Text, profile: LanguageProfile = LATIN) -> Column:
    """Vowels of a line, each of which counts as a syllable."""
    return F.regexp_count(F.lower(_c(line)), F.lit(f"[{profile.vowels}]"))


def shingles(text: Text, k: int = 5) -> Column:
    """Distinct runs of k words, lower case; a shorter text has one run of all its words."""
    w = lower_tokens(text, r"\p{L}+")
    one = F.transform(F.array(w), lambda x: F.transform(F.sequence(F.lit(0), F.greatest(F.size(x) - k, F.lit(0))), lambda i: F.array_join(F.slice(x, i + 1, k), " ")))
    return F.array_distinct(one[0])


def shingle_hashes(text: Text, k: int = 5) -> Column:
    """Hashes of the distinct runs of ``shingles``, without writing the runs."""
    runs = bound(lower_tokens(text, r"\p{L}+"), lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - k, F.lit(0))), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)])))
    return F.array_distinct(runs)


def letters(text: Text) -> Column:
    return F.regexp_count(_c(text), F.lit(r"\p{L}"))


# Normal forms ----------------------------------------------------------------------


def squeezed(text: Text) -> Column:
    """White space runs as one space, without any at the ends."""
    return F.trim(F.regexp_replace(_c(text), r"\s+", " "))


def fold_accents(text: Text, profile: LanguageProfile = LATIN) -> Column:
    return F.translate(F.lower(_c(text)), profile.accents_from, profile.accents_to)


def normalised_punctuation(text: Text, en_dash: bool = False) -> Column:
    """Double hyphens and spaced hyphens as dashes, the ellipsis sign as three dots."""
    out = F.replace(F.replace(F.replace(_c(text), F.lit("--"), F.lit("—")), F.lit(" - "), F.lit(" — ")), F.lit("…"), F.lit("..."))
    return F.replace(out, F.lit(" – "), F.lit(" — ")) if en_dash else out


def consonants(text: Text, profile: LanguageProfile = LATIN) -> Column:
    """A word's skeleton: what is left without vowels."""
    return F.regexp_replace(F.lower(_c(text)), f"[{profile.vowels}]", "")


def phonetic(tail: Text) -> Column:
    """What a Russian line's end sounds like, from its stressed vowel on: clusters of reflexive endings and signs
    simplified, the vowel as it is heard under stress, later ones reduced, the last consonant without voice, no
    doubled letters after the vowel."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(_c(tail), r"т?ь?ся$", "ца"), "сч", "щ"), "[ъь]", "")

    def sound(t: Column) -> Column:
        rest = F.translate(F.substring(t, F.lit(2), F.length(t)), *RUSSIAN_UNSTRESSED)
        last = bound(rest, lambda r: F.concat(F.left(r, F.length(r) - 1), F.translate(F.right(r, F.lit(1)), *RUSSIAN_DEVOICED)))
        return F.concat(F.translate(F.left(t, F.lit(1)), *RUSSIAN_STRESSED), F.regexp_replace(F.when(F.length(t) > 1, last).otherwise(""), r"(.)\1", "$1"))

    return bound(plain, sound)


def russian_syllables(line: Text) -> Column:
    return F.regexp_count(F.lower(_c(line)), F.lit(f"[{RUSSIAN_VOWELS}]"))


# HTML, URLs, ids -------------------------------------------------------------------

#: Names and numbers of characters, without the ampersand: the standard's named ones, and numbers of the C1 range,
#: which browsers read as Windows-1252.
_NAMED = {**html5, **{f"#{n};": bytes([n]).decode("cp1252", "replace") for n in range(128, 160)}, "#0;": "\ufffd"}
_REFERENCE = r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});?"

#: What an element does to the text: its content goes, it ends a line, it parts paragraphs. Other tags leave nothing.
DROPPED = ("script", "style", "ins", "noscript")
BREAKS = ("br",)
BLOCKS = ("p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "tr", "blockquote")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def unescape(html: Text, bare: bool = True) -> Column:
    """Character references as characters, each once: named ones, before other than letters also without their semicolon where the standard
    allows it, decimal and hexadecimal numbers; unknown ones stay. Without ``bare``, so do all that have no semicolon."""
    names = F.from_json(F.lit(json.dumps(_NAMED)), "map<string, string>")

    def character(part: Column) -> Column:
        body = F.regexp_replace(F.substring(part, F.lit(2), F.length(part)), ";$", "")
        number = F.when(body.rlike("^#[xX]"), F.conv(F.substring(body, F.lit(3), F.length(body)), 16, 10)).when(body.startswith("#"), F.substring(body, F.lit(2), F.length(body))).cast("int")
        told = F.coalesce(F.try_element_at(names, F.when(number.isNotNull(), F.concat(F.lit("#"), number.cast("string"), F.lit(";"))).otherwise(F.substring(part, F.lit(2), F.length(part)))))
        valid = (number < 0x110000) & ~number.between(0xD800, 0xDFFF)
        coded = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, number).otherwise(0xFFFD)), 8, "0")), "UTF-32")
        return F.coalesce(told, F.when(number.isNotNull(), coded), part)

    reference = _REFERENCE if bare else _REFERENCE.removesuffix("?")
    parts = F.regexp_extract_all(_c(html), F.lit(rf"{reference}|[^&]+|&"), F.lit(0))
    return F.when(F.contains(_c(html), F.lit("&")), F.array_join(F.transform(parts, lambda x: F.when(x.startswith("&") & (F.length(x) > 2), character(x)).otherwise(x)), "")).otherwise(_c(html))


def html_to_text(html: Text, bare: bool = True) -> Column:
    """Readable text of HTML by the rules of DROPPED, BREAKS and BLOCKS: line ends of the source are spaces, no-break
    spaces are plain ones, the indent that all lines share goes, lines end without white space, and at most one empty
    line stays between paragraphs. ``bare`` as in ``unescape``."""
    kept = F.regexp_replace(_c(html), rf"(?is)<({'|'.join(DROPPED)})\b.*?</\1\s*>", "")
    pieces = F.regexp_extract_all(kept, F.lit(r"(?s)<!--.*?-->|<[^>]+>|[^<]+|<"), F.lit(0))

    def written(piece: Column) -> Column:
        tag = F.lower(F.regexp_extract(piece, r"^</?([A-Za-z][A-Za-z0-9]*)\b[^>]*>$", 1))
        is_tag = piece.startswith("<") & (F.length(piece) > 1)
        return F.when(is_tag & tag.isin(*BREAKS) & ~piece.startswith("</"), "\n").when(is_tag & tag.isin(*BLOCKS), "\n\n").when(is_tag, "").otherwise(F.regexp_replace(piece, r"\r?\n", " "))

    plain = F.translate(unescape(F.array_join(F.transform(pieces, written), ""), bare), "\u00a0\r", " ")
    cut = F.transform(lines(plain), lambda x: F.regexp_replace(x, r"\s+$", ""))

    def dedented(rows: Column) -> Column:
        return bound(F.struct(rows.alias("rows"), F.array_min(F.transform(F.filter(rows, lambda x: x != ""), _indent)).alias("least")), lambda s: F.array_join(F.transform(s["rows"], lambda x: F.substring(x, s["least"] + 1, F.length(x))), "\n"))

    return F.regexp_replace(F.regexp_replace(F.coalesce(bound(cut, dedented), F.when(_c(html).isNotNull(), "")), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def _indent(line: Column) -> Column:
    return F.length(line) - F.length(F.regexp_replace(line, r"^[ \t]+", ""))


def link_share(html: Text) -> Column:
    """Share of a page's text that stands in links."""
    def bare(x: Column) -> Column:
        return F.length(squeezed(F.regexp_replace(x, r"<[^>]*>", " ")))

    links = F.aggregate(F.regexp_extract_all(_c(html), F.lit(r"(?is)<a\b[^>]*>(.*?)</a>"), F.lit(1)), F.lit(0), lambda n, x: n + bare(x))
    return F.when(bare(_c(html)) > 0, links / bare(_c(html))).otherwise(F.lit(0.0))


def tag_text(html: Text, tag: str, bare: bool = True) -> Column:
    """Text of a tag's first occurrence; '' if there is none. ``bare`` as in ``unescape``."""
    return squeezed(unescape(F.regexp_replace(F.regexp_extract(_c(html), rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1), r"<[^>]*>", " "), bare))


def path_segments(url: Text) -> Column:
    path = F.regexp_extract(_c(url), r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1)
    return F.filter(F.split(path, "/", -1), lambda x: x != "")


def section_of(url: Text) -> Column:
    """The first path segment, if there are two or more."""
    s = path_segments(url)
    return F.when(F.size(s) >= 2, s[0])


def host_of(url: Text) -> Column:
    return F.regexp_extract(_c(url), r"^[A-Za-z]+://([^/?#]+)", 1)


def clean_url(url: Text) -> Column:
    """Without fragment and last slash."""
    return F.regexp_replace(F.regexp_replace(_c(url), "#.*$", ""), "/+$", "")


def joined_url(base: Text, link: Text) -> Column:
    """A link seen from a page: absolute ones stay, rooted ones take the host, others the page's folder."""
    b, href = _c(base), _c(link)
    root = F.regexp_extract(b, r"^([A-Za-z]+://[^/?#]+)", 1)
    folder = F.regexp_replace(F.regexp_replace(b, r"[?#].*$", ""), r"(?<=[^/:])/[^/]*$", "")
    return clean_url(F.when(href.rlike("^[A-Za-z]+://"), href).when(href.startswith("/"), F.concat(root, href)).otherwise(F.concat(folder, F.lit("/"), href)))


def slug(text: Text) -> Column:
    """Lower-case letters and digits, joined by hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(_c(text)), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")


def uuid5(name: Text, namespace_hex: str = "6ba7b8119dad11d180b400c04fd430c8") -> Column:
    """The name-based (SHA-1) UUID; the default namespace is that of URLs."""
    h = F.substring(F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(_c(name), "UTF-8"))), 1, 32)
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def html_paragraphs(text: Text) -> Column:
    """A text as HTML: escaped, empty lines part paragraphs, line ends are breaks, leading spaces stay."""
    t = reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")), _c(text))
    t = F.regexp_replace(t, r"(?m)^ +", "&#160;")
    parts = F.filter(F.split(t, r"\n{2,}", -1), lambda p: F.trim(p) != "")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.lit("<p>"), F.replace(p, F.lit("\n"), F.lit("<br/>")), F.lit("</p>"))), "")


def script_safe_json(value: Column) -> Column:
    """Compact JSON that may stand inside a script element."""
    return F.replace(F.to_json(value), F.lit("</"), F.lit("<\\/"))


def highlighted(text: Text, word: str, before: str = "<b>", after: str = "</b>") -> Column:
    """Marks words with the word's stem: the word without its last letter if it has more than four."""
    stem = word[:-1] if len(word) > 4 else word
    return F.regexp_replace(_c(text), rf"(?iu)(?<!\p{{L}})({stem}\p{{L}}*)", f"{before}$1{after}")


def author_name(markup: Text) -> Column:
    """An author's name out of HTML credit lines."""
    return squeezed(F.regexp_replace(unescape(F.regexp_replace(_c(markup), r"<[^>]*>", " ")), r"(?i)\b(photo by|author|user):?", " "))


def is_free_licence(licence: Text) -> Column:
    return _c(licence).rlike(r"(?i)^(cc0|public domain|pd\b|cc[ -]by(-sa)?[ -]?[0-9.]*$)")


# Dates, numbers, forms -------------------------------------------------------------


def years(text: Text) -> Column:
    """Four-digit years 1000 to 2099, without decades such as 1970s."""
    return F.transform(F.regexp_extract_all(_c(text), F.lit(r"(?<![0-9])(1[0-9]{3}|20[0-9]{2})(?![0-9]|-?s)"), F.lit(1)), lambda y: y.cast("int"))


def date_line(line: Text, months: str = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec") -> Column:
    """Is a short line only a date: a year, with a month's name or a season or not?"""
    l = F.trim(_c(line))
    return (F.length(l) < 60) & (F.size(F.split(l, r"\s+")) <= 6) & l.rlike(rf"(?i)^[<(\[]?\s*([0-9]{{1,2}}[ .]*)?(({months})\p{{L}}*[ .,]*)?[0-9]{{4}}\s*[)\]>.]?$")


def per(part: Column, whole: Column, unit: float) -> Column:
    """A rate, null where the whole is 0."""
    return F.when(whole != 0, part * F.lit(float(unit)) / whole)


def plural(n: Column, *forms: str) -> Column:
    """Russian forms of a counted noun: one, few, many; or one and other."""
    if len(forms) == 2:
        return F.when((F.pmod(n, F.lit(10)) == 1) & (F.pmod(n, F.lit(100)) != 11), forms[0]).otherwise(forms[1])
    tens = F.pmod(n, F.lit(100))
    ones = F.pmod(n, F.lit(10))
    return F.when((ones == 1) & (tens != 11), forms[0]).when(ones.between(2, 4) & ~tens.between(12, 14), forms[1]).otherwise(forms[2])


def log_spaced(low: float, high: float, n: int) -> Column:
    """n whole numbers, evenly spaced in logarithm, each once."""
    step = F.lit(math.log(high / low) / (n - 1))
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.round(F.lit(float(low)) * F.exp(step * i)).cast("long")))


def mercator(lat: Column, lon: Column, at_lat: float) -> Column:
    """Metres east and north of the zero point, true to scale at a latitude."""
    r = 6378137.0
    scale = F.cos(F.radians(F.lit(at_lat)))
    x = F.radians(lon) * r * scale
    y = F.log(F.tan(F.lit(3.141592653589793 / 4) + F.radians(lat) / 2)) * r * scale
    return F.struct(x.alias("x"), y.alias("y"))


def luminance(hex_colour: Text) -> Column:
    """Relative luminance of '#rrggbb'."""
    def channel(at: int) -> Column:
        v = F.conv(F.substring(_c(hex_colour), at, 2), 16, 10).cast("double") / 255
        return F.when(v <= 0.03928, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))

    return 0.2126 * channel(2) + 0.7152 * channel(4) + 0.0722 * channel(6)


def snippet(line: Text, at: Text, reach: int = 70) -> Column:
    """What stands up to ``reach`` characters around a place (1-based), cut to whole words."""
    l, p = _c(line), _c(at)
    start = F.greatest(p - reach, F.lit(1))
    cut = F.substring(l, start, F.lit(2 * reach))
    cut = F.when(start > 1, F.regexp_replace(cut, r"^\S*\s+", "")).otherwise(cut)
    return F.when(start + 2 * reach <= F.length(l), F.regexp_replace(cut, r"\s+\S*$", "")).otherwise(cut)
