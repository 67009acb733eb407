"""Text normalisation shared by the operators of this folder."""

import html
import re
import unicodedata

_INVISIBLE = dict.fromkeys([*range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), 0xFEFF, 0x00AD])
_BROKEN = re.compile("[ÂÃÅÐÑâãï][\u0080-¿ŒœŠšŸŽžƒˆ˜–—‘-„†-•…‰‹›€™]{1,3}")
_TAG = re.compile(r"</?[a-zA-Z][^<>\n]{0,200}>")


def _mend(m: re.Match) -> str:
    """UTF-8 that was decoded as Windows-1252 or Latin-1, where it is that."""
    raw = bytearray()
    for c in m.group():
        try:
            raw += c.encode("cp1252")
        except UnicodeEncodeError:
            if ord(c) > 0xFF:
                return m.group()
            raw.append(ord(c))
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return m.group()


def mend(text: str) -> str:
    """Mis-decoded characters put right."""
    return text if text.isascii() else _BROKEN.sub(_mend, text)


def plain(text: str) -> str:
    """Without entities, mis-decoded characters, markup tags, invisible characters and compatibility forms."""
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", mend(text).translate(_INVISIBLE))
    return _TAG.sub(" ", text) if "<" in text else text
