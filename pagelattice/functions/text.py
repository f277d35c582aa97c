"""Column functions over strings: character tests, query cleaning, samples, labels, links, dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as layout knows it, as a character class body of Java's regular expressions.
SPACE = r"\s\p{Z}\x{85}"
#: Fixed value: the link pattern.
URL = (
    r"(((https?|ftps?):\/\/)|www\.)(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.)+[a-zA-Z]{2,}"
    r"(?::(?:0|[1-9]\d{0,3}|[1-5]\d{4}|6[0-4]\d{3}|65[0-4]\d{2}|655[0-2]\d|6553[0-5]))?(?:\/(?:[-a-zA-Z0-9@%_\+.~#?&=]+\/?)*)?"
)
#: Schemes that a link may open, units of sizes, characters that file names must not have.
SCHEMES = ("ftp", "http", "https", "mailto", "tel", "imap", "file")
UNITS = ("bytes", "KB", "MB", "GB", "TB", "PB", "EB", "ZB", "YB")
BAD_IN_NAMES = r'[\x00-\x1f"<>|:*?\\/]'


def is_blank(s: Column) -> Column:
    return s.rlike(f"^[{SPACE}]*$")


def all_punctuation(s: Column) -> Column:
    """True for the empty string too."""
    return s.rlike(r"^\p{P}*$")


def all_separators(s: Column) -> Column:
    return s.rlike(r"^\p{Z}*$")


def links_to_nothing(s: Column) -> Column:
    """Letters that can neither start nor end a link between letters."""
    return is_blank(s) | all_punctuation(s) | all_separators(s)


def clean_query(q: Column) -> Column:
    """A query as the page index has it: every punctuation mark a word of its own, but no space before the first character
    or after the last one."""
    spaced = F.regexp_replace(q, r"(\p{P})", " $1 ")
    first = F.when(q.rlike(r"^\p{P}"), F.substr(spaced, F.lit(2))).otherwise(spaced)
    return F.when(q.rlike(r"\p{P}$"), F.left(first, F.length(first) - 1)).otherwise(first)


def word_count(cleaned: Column) -> Column:
    """Words of a cleaned query: its spaces plus one, less one for each end that is a space."""
    spaces = F.length(cleaned) - F.length(F.replace(cleaned, F.lit(" "), F.lit("")))
    edge = lambda x: F.when(x, 1).otherwise(0)
    return spaces + 1 - edge(cleaned.startswith(" ")) - edge(cleaned.endswith(" ") & (F.length(cleaned) > 1))


def sample(text: Column, at: Column) -> Column:
    """Up to 40 characters, from 10 before position `at` on."""
    return F.substr(text, F.greatest(at - 10, F.lit(0)) + 1, F.lit(40))


def space_between(before: Column, now: Column) -> Column:
    """Whether a space belongs between two tokens: none after an opening mark, dash or connector, none before a closing mark."""
    return ~(before.rlike(r"[\p{Ps}\p{Pi}\p{Pd}\p{Pc}]$") | now.rlike(r"^[\p{Pe}\p{Pf}\p{Po}\p{Pd}\p{Sm}\p{Sc}]"))


def hyphenated(before: Column, line_before: Column, line: Column) -> Column:
    """Whether a token goes on with the last token of the line before, whose last character is a dash or connector."""
    return (line > line_before) & before.rlike(r"[\p{Pc}\p{Pd}]$")


def url_of(s: Column) -> Column:
    """The first link in a string, else null."""
    return F.nullif(F.regexp_extract(s, URL, 0), F.lit(""))


def openable(uri: Column) -> Column:
    """The address to open, else null: http:// is put before a bare one, other schemes than SCHEMES are refused."""
    bare = ~uri.contains(":") & ~uri.startswith("http")
    whole = F.when(bare, F.concat(F.lit("http://"), uri)).otherwise(uri)
    return F.when((uri != "") & F.substring_index(whole, ":", 1).isin(*SCHEMES), whole)


def is_pdf(path: Column) -> Column:
    return F.lower(path).endswith(".pdf")


def size_label(n: Column) -> Column:
    """A byte count with one decimal in steps of 1024; a value that would show 1000 or more moves to the next unit."""
    size = F.abs(n).cast("decimal(30,0)")
    shown = lambda k: F.concat(F.format_string("%.1f", F.round(size.cast("double") / 1024.0**k, 1)), F.lit(f" {UNITS[k]}"))
    label = F.when(size < 1, F.lit("0.0 bytes"))
    for k in range(6, -1, -1):
        step = F.when(F.round(size.cast("double") / 1024.0**k, 1) >= 1000, shown(k + 1)).otherwise(shown(k))
        label = label.when(size.cast("double") >= 1024.0**k, step)
    return F.concat(F.when(n < 0, "-").otherwise(""), label)


def file_name(name: Column, substitute: str = "_") -> Column:
    """A name with characters that file systems refuse replaced (or dropped, where substitute is empty)."""
    return F.regexp_replace(name, BAD_IN_NAMES, substitute)


def path_key(path: Column) -> Column:
    """Base64 of a path, in one line however long it is, with # for backslash. (Spark may break the lines of base64.)"""
    return F.translate(F.base64(F.encode(path, "UTF-8")), "\\\r\n", "#")


def pdf_date(s: Column) -> Column:
    """A PDF date as yyyy-MM-dd HH:mm:ss and offset; what can't be read stays as it is."""
    bare = F.regexp_replace(s, "^D:", "")
    zone = F.regexp_replace(F.regexp_extract(bare, r"^\d{14}(.*)$", 1), r"^([+-]\d{2})'?(\d{2})'?$", "$1:$2")
    zone = F.when(zone.isin("", "Z", "Z00'00'", "+00:00"), "+00:00").otherwise(zone)
    stamp = F.try_to_timestamp(F.regexp_extract(bare, r"^(\d{14})", 1), F.lit("yyyyMMddHHmmss"))
    return F.when(stamp.isNotNull() & zone.rlike(r"^[+-]\d{2}:\d{2}$"), F.concat(F.date_format(stamp, "yyyy-MM-dd HH:mm:ss "), zone)).otherwise(s)


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance over the longer length; null for two empty strings."""
    return F.levenshtein(a, b) / F.nullif(F.greatest(F.length(a), F.length(b)), F.lit(0))


def log_name(s: Column) -> Column:
    """Cut or filled to 15 characters."""
    return F.rpad(s, 15, " ")


def hit_label(sample_: Column) -> Column:
    return F.concat(F.lit("..."), sample_, F.lit("..."))


def page_label(page: Column, hits: Column) -> Column:
    return F.concat(page.cast("string"), F.lit(" ("), hits.cast("string"), F.lit(")"))


def without_nul(s: Column) -> Column:
    """NUL as space; null where nothing but white space is left."""
    out = F.translate(s, "\x00", " ")
    return F.when(~is_blank(out), out)


def last_character(letter: Column, ends: Column) -> Column:
    """The character (from 0) with which a letter ends; ends: the word's map from letters to characters, null where letters are characters."""
    return F.coalesce(F.get(ends, letter) - 1, letter).cast("int")


def letter_starts(ends: Column, n_letters: Column) -> Column:
    """Where each letter begins in characters, from the map of their ends, or from their number where there is none."""
    plain = F.when(n_letters > 0, F.sequence(F.lit(0), n_letters - 1))
    return F.coalesce(F.transform(ends, lambda _, i: F.when(i > 0, F.get(ends, i - 1)).otherwise(F.lit(0))), plain)


def partial_word(value: Column, start: Column, end: Column, char_index: Column | None = None) -> Column:
    """Letters start..end of a word; both go through the letters' map to characters where a word has ligatures."""
    if char_index is None:
        return F.substr(value, start + 1, end - start + 1)
    a = F.get(char_index, start)
    b = F.coalesce(F.get(char_index, end + 1) - 1, F.length(value) - 1)
    return F.substr(value, a + 1, b - a + 1)
