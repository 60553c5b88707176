"""Content digests and text normalisation, as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from samplemill.functions.ids import as_column, bound

# Letters that have no decomposition, with their ASCII spelling.
LIGATURES = {
    "Æ": "AE",
    "Ø": "O",
    "Þ": "Th",
    "ß": "ss",
    "æ": "ae",
    "ø": "o",
    "þ": "th",
    "Đ": "D",
    "đ": "d",
    "Ł": "L",
    "ł": "l",
    "Œ": "OE",
    "œ": "oe",
}


def digest(content: Column | str) -> Column:
    return F.md5(as_column(content).cast("binary"))


def sha256(content: Column | str) -> Column:
    return F.sha2(as_column(content).cast("binary"), 256)


def content_differs(content: Column | str, id_col: Column | str) -> Column:
    """True where the content hash is not the id."""
    return ~sha256(content).eqNullSafe(as_column(id_col))


def without_block_comments(text: Column | str) -> Column:
    return F.regexp_replace(as_column(text), r"(?s)/\*.*?\*/", "")


def instructions(listing: Column | str) -> Column:
    """Last tab-separated field, stripped, of every line that has a tab."""
    lines = F.filter(F.split(as_column(listing), "\n"), lambda x: x.contains("\t"))
    return F.array_join(F.transform(lines, lambda x: F.trim(F.substring_index(x, "\t", -1))), "\n")


def without_signatures(listing: Column | str) -> Column:
    """Drop the first line of every block; blocks are separated by a blank line."""
    blocks = F.split(as_column(listing), "\n\n")
    bodies = F.transform(
        blocks, lambda b: F.when(b.contains("\n"), F.substring(b, F.instr(b, "\n") + 1, F.length(b))).otherwise(F.lit(""))
    )
    return F.array_join(bodies, "\n\n")


def _letters() -> dict[str, str]:
    """Latin letters with accents and the ASCII letter they decompose to (from the Unicode tables)."""
    out = {}
    for code in range(0xC0, 0x250):
        base = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if len(base) == 1:
            out[chr(code)] = base
    return out


def to_ascii(text: Column | str) -> Column:
    """ASCII spelling of Latin text; characters without one are dropped."""
    out = as_column(text)
    for letter, spelling in LIGATURES.items():
        if len(spelling) > 1:
            out = F.replace(out, F.lit(letter), F.lit(spelling))
    table = _letters() | {k: v for k, v in LIGATURES.items() if len(v) == 1}
    out = F.translate(out, "".join(table), "".join(table.values()))
    return F.regexp_replace(out, r"[^\x00-\x7F]", "")


def collapse_runs(text: Column | str, at_least: int) -> Column:
    """Replace ``at_least`` or more equal characters in a row by one."""
    return F.regexp_replace(as_column(text), r"(?s)(.)\1{%d,}" % (at_least - 1), "$1")


def collapse_byte_runs(content: Column | str, at_least: int) -> Column:
    """The same on bytes: line feeds are not collapsed, as ``.`` does not match them there."""
    latin = F.decode(as_column(content), "ISO-8859-1")
    return F.encode(F.regexp_replace(latin, r"([^\n])\1{%d,}" % (at_least - 1), "$1"), "ISO-8859-1")


def latin1(content: Column | str) -> Column:
    return F.decode(as_column(content), "ISO-8859-1")


# Fixed value: byte b is shown as the character with code point OFFSET + b.
OFFSET = 10752


def printable_bytes(content: Column | str) -> Column:
    """One printable character per byte, by translating the Latin-1 text."""
    source = "".join(chr(b) for b in range(1, 256))
    target = "".join(chr(OFFSET + b) for b in range(1, 256))
    # NUL ends the list of characters for translate, so it is replaced on its own.
    return F.replace(F.translate(latin1(content), source, target), F.lit("\x00"), F.lit(chr(OFFSET)))


#: A letter or digit, with a mark between them or not, while the hex switch is on.
_HEX = r"(?:fun_|[\p{L}\p{N}])*+"
#: A run from the mark that turns a switch on to the end of the last one: after ``fun_`` up to a ``(`` that ends no
#: hex run, in which ``0x`` starts one that its first other character ends; after ``0x`` up to such a character or ``fun_``.
_NAME = rf"(?s:0x{_HEX}.?|[^(])*+"
_RUN = rf"fun_{_NAME}|0x(?:(?!fun_)[\p{{L}}\p{{N}}])*+(?:fun_{_HEX}(?s:.?){_NAME})?"
#: What a text consists of: such runs, and all between them.
SEGMENTS = rf"{_RUN}|(?:[^0f]++|(?!0x|fun_)[0f])++"
#: What a run consists of: characters that stay though they have capitals (no letters or digits), and all others.
PIECES = r"0x|[\x{345}\x{24D0}-\x{24E9}]|(?:[^0\x{345}\x{24D0}-\x{24E9}]++|0(?!x))++"


def capitalize_hex(text: Column | str) -> Column:
    """Upper-case the digits after ``0x`` and the name after ``fun_`` up to ``(``.

    Two switches: ``0x`` turns the hex one on until a character that is no letter or digit, ``fun_`` the name one
    until a ``(`` that does not already end a hex run. Letters and digits after either are upper case, and so is
    the word ``fun``; marks are not. Both switches are regular, so that a run with one of them on is one match,
    and only such runs are looked at piece by piece; a text without marks is one segment. NULL gives an empty text.
    """
    stays = lambda p: p.rlike(r"^(?:0x|[\x{345}\x{24D0}-\x{24E9}])")

    def raised(run: Column) -> Column:
        first = F.when(run.startswith("0x"), F.lit("0x")).otherwise(F.lit("fun_"))
        rest = F.regexp_extract_all(F.substring(run, F.length(first) + 1, F.length(run)), F.lit(PIECES), F.lit(0))
        return F.concat(first, F.array_join(F.transform(rest, lambda p: F.when(stays(p), p).otherwise(F.upper(p))), ""))

    segments = F.regexp_extract_all(as_column(text), F.lit(SEGMENTS), F.lit(0))
    starts = lambda s: s.startswith("0x") | s.startswith("fun_")
    shown = F.array_join(F.transform(segments, lambda s: F.when(starts(s), raised(s)).otherwise(s)), "")
    return F.coalesce(shown, F.lit(""))
