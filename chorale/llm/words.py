"""Words of texts in any dress: entities, broken encodings, accents and case undone."""

from __future__ import annotations

import html
import re
import unicodedata

#: UTF-8 bytes shown as Latin-1 or Windows-1252 characters.
_BROKEN = re.compile("[Â-ô][\x80-¿ŒœŠšŸŽžƒˆ˜–—‘’‚“”„†‡•…‰‹›€™]{1,3}")
_LETTERS = re.compile(r"[^\W\d_]+")
_MARKS = re.compile(r"[̀-ͯ҃-҉֑-ׇ᪰-᫿᷀-᷿⃐-⃿゙゚︠-︯]+")
#: Letters that carry a stroke, ligature or missing dot instead of a separable accent.
_PLAIN = str.maketrans({"ı": "i", "ł": "l", "ø": "o", "đ": "d", "æ": "ae", "œ": "oe", "ð": "d", "ħ": "h"})


def _mend(m: re.Match) -> str:
    raw = bytearray()
    for c in m.group():
        try:
            raw += c.encode("cp1252")
        except UnicodeEncodeError:
            if ord(c) > 255:
                return m.group()
            raw.append(ord(c))
    for end in range(len(raw), 1, -1):
        try:
            return raw[:end].decode("utf-8") + m.group()[end:]
        except UnicodeDecodeError:
            pass
    return m.group()


def mended(text: str) -> str:
    """Entities and doubly encoded characters replaced by what they stand for."""
    if "&" in text:
        text = html.unescape(text)
    return text if text.isascii() else _BROKEN.sub(_mend, text)


def folded(text: str) -> str:
    """Lower case without accents."""
    text = mended(text)
    if text.isascii():
        return text.lower()
    return _MARKS.sub("", unicodedata.normalize("NFKD", text.casefold())).translate(_PLAIN)


def letter_words(text: str) -> list[str]:
    """Runs of letters, folded."""
    return _LETTERS.findall(folded(text))
