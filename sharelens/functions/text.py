"""Scalar expressions on text: links, hosts, tokens, descriptions, LaTeX."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Patterns that decide results. URL_PATTERN is regrouped: group 1 is the whole URL after its scheme, and group 2
# what the published grouping returned, which lacks the last character.
HOST_PATTERN = r"(https?:\/\/)?(www\.)?([A-Za-z_0-9.-]+).*"
URL_PATTERN = r"(?:[a-z]+://|www\.|[^\s:=]+@www\.)(([^/].*?[a-z0-9].*?)([a-z_\/0-9\-\#=&]|))(?=[\.,;\?\!]?(['«»\[\s\r\n]|$))"
BARE_DOMAIN_PATTERN = r"[-a-zA-Z0-9@:%._\+~#=]{1,256}\.[a-zA-Z0-9()]{1,6}\b([-a-zA-Z0-9()@:%_\+.~#?&=]*)"
HTTP_URL_PATTERN = r"https?:\/\/(www\.)?[-a-zA-Z0-9@:%._\+~#=]{1,256}\.[a-zA-Z0-9()]{1,6}\b([-a-zA-Z0-9()@:%_\+.~#?&\/\/=]*)"
TOKEN_PATTERN = r"([\p{L}\p{N}_]{2,})"
LATIN_TOKEN_PATTERN = r"(?<![\p{L}\p{N}_])([a-z]{2,}+)(?![\p{L}\p{N}_])"
META_TAG_PATTERN = r"""(?i)(<meta\b(?:[^>"']|"[^"]*"|'[^']*')*>)"""
META_NAME_PATTERN = r"""(?i:\sname\s*=\s*)(?:"[^"]*[dD]esc[^"]*"|'[^']*[dD]esc[^']*'|[^\s"'>]*[dD]esc)"""
META_CONTENT_PATTERN = r"""(?i:\scontent\s*=\s*)(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
MARKDOWN_LINK_PATTERN = r"\[(.*?)\]\(.*?\)"
NON_LATIN_PATTERN = r"[^\x{00}-\x{7F}\x{80}-\x{FF}\x{100}-\x{17F}\x{180}-\x{24F}\x{1E00}-\x{1EFF}]"
OFFENSIVE_WORDS = [("n.gger", "n-gger"), ("f.ggot", "f-ggot"), ("r.tard", "r-tard")]
BANNED_SENTENCES = ["Subreddit forbidden", "Subreddit no longer exists"]
BANNED_TEXT = r"\textit{Community banned or deleted prior to publication}"
SITE_HOSTS = ["reddit.com", "old.reddit.com", "new.reddit.com"]


def unescape_body(body: Column) -> Column:
    """Undo HTML escapes, ``&amp;`` last, then CRLF to LF."""
    text = F.replace(body, F.lit("&gt;"), F.lit(">"))
    text = F.replace(text, F.lit("&lt;"), F.lit("<"))
    text = F.replace(text, F.lit("&amp;"), F.lit("&"))
    return F.replace(text, F.lit("\r\n"), F.lit("\n"))


def has_link(body: Column) -> Column:
    return body.contains("http://") | body.contains("https://")


def extract_url(body: Column, compat: bool = False) -> Column:
    """First URL without its scheme; ``compat`` loses the last character as published."""
    return F.regexp_extract(body, URL_PATTERN, 2 if compat else 1)


def extract_all_urls(body: Column) -> Column:
    return F.regexp_extract_all(body, F.lit(URL_PATTERN), F.lit(1))


def extract_host(url: Column, normalize: bool = False) -> Column:
    """Host part of a URL, case kept; ``normalize`` lowercases the URL first."""
    return F.regexp_extract(F.lower(url) if normalize else url, HOST_PATTERN, 3)


def remove_urls(text: Column) -> Column:
    """Text without bare domains and http(s) URLs.

    Both patterns need a dot followed by a letter, digit or parenthesis; texts
    without one are left alone. In the others a first alternative swallows each
    run of domain characters that neither a dot nor a slash follows and puts it
    back, so the backtracking domain pattern only starts where it can match.
    """
    # (?U) makes the word boundary Unicode-aware on every Java release
    pattern = rf"(?U){HTTP_URL_PATTERN}|([-a-zA-Z0-9@:%_\+~#=]++(?![./]))|{BARE_DOMAIN_PATTERN}"
    return F.when(
        text.rlike(r"\.[a-zA-Z0-9()]"), F.regexp_replace(text, pattern, "$3")
    ).otherwise(text)


def tokens(text: Column, latin_only: bool = False) -> Column:
    """Lowercased words of two or more characters; ``latin_only`` keeps those of a-z alone."""
    pattern = LATIN_TOKEN_PATTERN if latin_only else TOKEN_PATTERN
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(1))


def is_latin(word: Column) -> Column:
    return word.rlike("^[a-z]+$")


def english_stop_words(spark: SparkSession) -> list[str]:
    """Spark ML's English list."""
    remover = spark._jvm.org.apache.spark.ml.feature.StopWordsRemover
    return list(remover.loadDefaultStopWords("english"))


def page_description(html: Column) -> Column:
    """``content`` of the first ``<meta>`` named like a description, else ``''``."""
    tags = F.regexp_extract_all(html, F.lit(META_TAG_PATTERN), F.lit(1))
    first = F.get(F.filter(tags, lambda t: t.rlike(META_NAME_PATTERN)), F.lit(0))
    content = F.concat(*[F.regexp_extract(first, META_CONTENT_PATTERN, i) for i in (1, 2, 3)])
    return F.coalesce(unescape_html(content), F.lit(""))


# A reference is a number or a name; names are those of HTML 5, from the standard library.
REFERENCE_PATTERN = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
#: Names that also count without a semicolon, longest first, as one pattern.
_BARE_NAMES = "^(?:" + "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))) + ")"


def _named() -> Column:
    """Name -> characters, as a literal map."""
    return F.str_to_map(F.lit("\x02".join(f"{name}\x01{text}" for name, text in html5.items())), F.lit("\x02"), F.lit("\x01"))


def _character(number: Column) -> Column:
    """What a numeric reference stands for: windows-1252 from 128 to 159, nothing for code points that are no characters."""
    legacy = {n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)}
    old = F.get(F.array(*(F.lit(legacy[n]) for n in range(0x80, 0xA0))), (number - 0x80).cast("int"))
    none = number.between(1, 8) | number.isin(0x0B, 0x7F) | number.between(0x0E, 0x1F) | number.between(0xFDD0, 0xFDEF)
    bad = (number == 0) | number.between(0xD800, 0xDFFF) | (number > 0x10FFFF) | number.isNull()
    plain = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    none = none | (number.bitwiseAND(0xFFFE) == 0xFFFE)
    return F.when(bad, "\ufffd").when(number.between(0x80, 0x9F), old).when(none, "").otherwise(plain)


def _decoded(reference: Column) -> Column:
    """One reference, given with its ampersand."""
    hexa = F.regexp_extract(reference, "^&#[xX]0*([0-9a-fA-F]+)", 1)
    deci = F.regexp_extract(reference, "^&#0*([0-9]+)", 1)
    # more digits than any code point has are out of range
    number = F.when(hexa != "", F.when(F.length(hexa) <= 8, F.conv(hexa, 16, 10).cast("bigint"))).otherwise(
        F.when(F.length(deci) <= 12, deci.try_cast("bigint"))
    )
    name = F.substr(reference, F.lit(2))
    bare = F.regexp_extract(name, _BARE_NAMES, 0)
    rest = F.substr(name, F.length(bare) + 1)
    loose = F.when(bare != "", F.concat(F.try_element_at(_named(), bare), rest)).otherwise(reference)
    return F.when(reference.startswith("&#"), _character(number)).otherwise(F.coalesce(F.try_element_at(_named(), name), loose))


def unescape_html(text: Column) -> Column:
    """All numeric and named character references decoded, as a browser does, in one pass."""
    references = F.regexp_extract_all(text, F.lit(REFERENCE_PATTERN), F.lit(0))
    between = F.split(text, REFERENCE_PATTERN, -1)
    # there is one piece more than references; the lambda sees single elements, so the text is cut up once
    parts = F.zip_with(between, references, lambda gap, found: F.concat(gap, F.coalesce(_decoded(found), F.lit(""))))
    return F.when(text.contains("&"), F.array_join(parts, "")).otherwise(text)


def clean_description(text: Column) -> Column:
    """Drop markdown marks, keep link texts, drop non-Latin characters."""
    text = F.translate(text, "#*", "  ")
    text = F.regexp_replace(text, MARKDOWN_LINK_PATTERN, "$1")
    return F.regexp_replace(text, NON_LATIN_PATTERN, "")


# How text breaks into chunks, as Python's textwrap does it: runs of white space, dashes between words, and words up
# to a hyphen between letters. In Java's classes, a letter or digit is [\\p{L}\\p{N}_], a letter [\\p{L}\\p{Nl}\\p{No}_].
WHITE = r"[\t\n\x0B\f\r ]"
CHUNK_PATTERN = (
    r"[\t\n\x0B\f\r ]+|(?<=[\p{L}\p{N}_!\x22'&.,?])-{2,}(?=[\p{L}\p{N}_])|[^\t\n\x0B\f\r ]+?(?:-(?:(?<=[\p{L}\p{Nl}\p{No}_]{2}-)|(?<=[\p{L}\p{Nl}\p{No}_]-[\p{L}\p{Nl}\p{No}_]-))"
    r"(?=[\p{L}\p{Nl}\p{No}_]-?[\p{L}\p{Nl}\p{No}_])|(?=[\t\n\x0B\f\r ]|\z)|(?<=[\p{L}\p{N}_!\x22'&.,?])(?=-{2,}[\p{L}\p{N}_]))"
)
BLANK = r"^[\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]*$"


def _expand_tabs(text: Column, size: int = 8) -> Column:
    """Tabs up to the next multiple of ``size`` since the last line break."""
    pieces = F.split(text, "\t", -1)

    def put(line: Column, piece: Column) -> Column:
        column = F.length(F.regexp_extract(line, r"[^\n\r]*\z", 0))
        return F.concat(line, F.repeat(F.lit(" "), F.lit(size) - column % size), piece)

    whole = F.aggregate(F.slice(pieces, F.lit(2), F.size(pieces)), F.get(pieces, F.lit(0)), put)
    return F.when(text.contains("\t"), whole).otherwise(text)


def first_line(text: Column, width: int = 130) -> Column:
    """First wrapped line, with ``...`` when anything was cut.

    Breaks at white space and after hyphens as Python's ``textwrap`` does. Only the head of a text is looked
    at: a chunk that starts within the first line and does not end in the head is longer than a line anyway.
    White space in front counts as part of the first line unless a word does not fit behind it.
    """
    indent = F.regexp_extract(text, f"^{WHITE}*", 0)
    head = F.concat(indent, F.substr(text, F.length(indent) + 1, F.lit(2 * width + 16)))
    flat = F.translate(_expand_tabs(head), "\t\n\x0b\f\r", "     ")
    blank = F.length(F.regexp_extract(flat, "^ *", 0))
    # lines of white space alone are dropped as a whole
    left = F.when(blank > width, (blank - 1) % width + 1).otherwise(blank)
    chunks = F.regexp_extract_all(F.substr(flat, blank - left + 1), F.lit(CHUNK_PATTERN), F.lit(0))

    def put(t: Column, chunk: Column) -> Column:
        line = F.concat(t["line"], t["tail"])
        room = F.lit(width) - F.length(line)
        cut = F.substr(chunk, F.lit(1), room)
        hyphen = F.regexp_extract(cut, "^(.*-)[^-]*$", 1)
        part = F.when(hyphen.rlike("[^-]"), hyphen).otherwise(cut)
        state = lambda a, b, done: F.struct(a.alias("line"), b.alias("tail"), F.lit(done).alias("done"))
        return (
            F.when(t["done"], t)
            .when(F.length(chunk) <= room, state(line, chunk, False))
            .when(F.length(chunk) > width, state(line, part, True))
            .when((t["line"] == "") & t["tail"].rlike(BLANK), state(F.lit(""), chunk, False))
            .otherwise(state(t["line"], t["tail"], True))
        )

    start = F.struct(F.lit("").alias("line"), F.lit("").alias("tail"), F.lit(False).alias("done"))
    wrapped = F.aggregate(
        chunks, start, put, lambda t: F.when(t["tail"].rlike(BLANK), t["line"]).otherwise(F.concat(t["line"], t["tail"]))
    )
    return F.when(wrapped != text, F.concat(wrapped, F.lit("..."))).otherwise(wrapped)


# Fixed values, in the order in which they must be replaced; the backslash waits in a placeholder until braces are done.
TEX_ESCAPES = [
    ("\\", "\u0001"),
    ("{", r"\{"),
    ("}", r"\}"),
    ("&", r"\&"),
    ("%", r"\%"),
    ("$", r"\$"),
    ("#", r"\#"),
    ("_", r"\_"),
    ("~", r"\textasciitilde{}"),
    ("^", r"\^{}"),
    ("<", r"\textless{}"),
    (">", r"\textgreater{}"),
    ("\u0001", r"\textbackslash{}"),
]


def tex_escape(text: Column) -> Column:
    """LaTeX-safe text."""
    for old, new in TEX_ESCAPES:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def replace_status(text: Column) -> Column:
    return F.when(text.isin(BANNED_SENTENCES), F.lit(BANNED_TEXT)).otherwise(text)


def letter_bucket(name: Column) -> Column:
    letter = F.upper(F.substring(name, 1, 1))
    return F.when(letter.rlike("^[A-Z]"), letter).otherwise(F.lit("0-9"))


def score_tag(prefix: str, value: Column) -> Column:
    """``age`` and -2 become ``age_n2``."""
    return F.concat(F.lit(prefix + "_"), F.replace(value.cast("string"), F.lit("-"), F.lit("n")))


def redact(word: Column) -> Column:
    for pattern, replacement in OFFENSIVE_WORDS:
        word = F.regexp_replace(word, pattern, replacement)
    return word
