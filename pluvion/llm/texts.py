"""Words of a text as the matching operators see them."""

import json
import re

#: Characters without width, and Cyrillic letters that look like Latin ones.
INVISIBLE = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
LOOKALIKES = dict(zip(map(ord, "асеіјорѕухһԁԛԝАВСЕНІЈКМОРЅТУХ"), "aceijopsyxhdqwABCEHIJKMOPSTYX"))
#: A tag: its name and attributes, whatever their length.
TAG = re.compile(r"""</?[a-zA-Z][\w:-]*(?:[ \t]+[\w:@.-]+(?:[ \t]*=[ \t]*(?:"[^"\n]*"|'[^'\n]*'|[^\s"'<>]+))?)*[ \t]*/?>""")
_WORD = re.compile(r"\w+")


def plain(text: str | None) -> str:
    """The text itself, or the strings of a JSON object one under another. NULL counts as empty."""
    if text and text.lstrip("﻿ \n")[:1] == "{":
        try:
            return "\n".join(v for v in json.loads(text.lstrip("﻿")).values() if isinstance(v, str))
        except (ValueError, AttributeError):
            pass
    return text or ""


def words(text: str | None) -> list[str]:
    """Lower-case words without markup, whatever the line breaks, spaces and look-alike letters."""
    t = plain(text)
    if not t.isascii():
        t = t.translate(INVISIBLE)
        # only in words that mix scripts; Cyrillic text stays what it is
        t = re.sub(r"\w*[a-zA-Z]\w*", lambda m: m[0] if m[0].isascii() else m[0].translate(LOOKALIKES), t)
    return _WORD.findall(TAG.sub(" ", t).lower())
