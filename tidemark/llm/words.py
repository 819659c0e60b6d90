"""Texts to words without what does not count: case, punctuation, markup, escapes, look-alikes, invisibles."""

from __future__ import annotations

import html
import re
import unicodedata

# Cyrillic and Greek letters that look like Latin ones, lower case. Applied to both sides of a
# comparison, so words in these scripts stay comparable with each other.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ɡ": "g", "һ": "h", "н": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l", "ⅼ": "l", "м": "m",
    "п": "n", "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "ս": "u", "ц": "u", "ν": "v", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "ү": "y",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ħ": "h",
}
_INLINE = re.compile(r"</?(?:b|i|u|s|em|strong|span|a|font|mark|sub|sup|small|big|tt|code)(?:\s[^<>]{0,300})?/?>", re.I)
_TAG = re.compile(r"</?[a-zA-Z!][^<>]{0,500}>")
_UNICODE_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})")
_CHAR_ESCAPE = re.compile(r"\\[nrtfv]|%20|%0[aAdD]|\\\\")
# The patterns start with what is rare, so that the search skips to it.
_BROKEN = re.compile("[-=\\\\\u00ac\u00ad\u2010\u2011](?<=[^\\W\\d_].)[ \\t]*\\r?\\n[ \\t>|#*/;]*(?=[^\\W\\d_])")
_INNER = re.compile(rb"[.,:](?<=[0-9].)(?=[0-9])|'(?<=[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f].)(?=[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f])")
_BYTES = bytes(i + 32 if 65 <= i <= 90 else i if i >= 128 or chr(i).isalnum() else 32 for i in range(256))
BREAK = b"\x00"


class _Drop(dict):
    """Translation table filled as characters occur: marks and format characters go, look-alikes fold."""

    def __missing__(self, code: int):
        c = chr(code)
        if c in LOOKALIKES:
            out = LOOKALIKES[c]
        elif unicodedata.category(c) in ("Mn", "Me", "Cf"):
            out = None
        elif c in "\u2019\u02bc":
            out = "'"
        elif "\u2e80" <= c <= "\u9fff" and c.isalnum() or "\uf900" <= c <= "\ufaff" or c >= "\U00020000" and c.isalnum():
            out = f" {c} "
        elif not c.isalnum():
            out = " "
        else:
            out = code
        self[code] = out
        return out


_TABLE = _Drop()
_TABLE.update({i: i for i in range(128)})


def fold(text: str) -> bytes:
    """The text as UTF-8 of lower-case letters, digits and blanks."""
    if "\\" in text:
        text = _CHAR_ESCAPE.sub(" ", _UNICODE_ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)), text))
    elif "%" in text:
        text = _CHAR_ESCAPE.sub(" ", text)
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    if "&" in text:
        text = html.unescape(text)
    if "\n" in text:
        text = _BROKEN.sub("", text)
    if not text.isascii():
        # Compatibility forms first (full width, circled, styled), then marks off, then case.
        text = unicodedata.normalize("NFKD", text).casefold().translate(_TABLE)
    return _INNER.sub(b"", text.encode("utf-8", "replace")).translate(_BYTES)


def words(text: str | None) -> list[bytes]:
    """Comparable words as UTF-8; every Han character is a word of its own. Null gives none."""
    return fold(text).split() if text else []


def batch_words(texts: list[str | None]) -> list[bytes]:
    """The words of many texts in one list, with BREAK after each text."""
    return b" ".join([fold(t) + b" \x00" if t else BREAK for t in texts]).split()
