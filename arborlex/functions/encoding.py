"""Decoding of file bytes: byte-order marks, hints, BOM-less UTF-16, ISO-2022-JP, UTF-8, then windows-1252.

The statistical guess among legacy code pages that other tools make between
UTF-8 and windows-1252 is left out: name the code page by a hint instead.
"""

from __future__ import annotations

import codecs
import re
from typing import NamedTuple

import numpy as np


class Decoded(NamedTuple):
    text: str
    encoding: str
    lossy: bool


_BOMS = ((codecs.BOM_UTF8, "UTF-8"), (codecs.BOM_UTF16_LE, "UTF-16LE"), (codecs.BOM_UTF16_BE, "UTF-16BE"))
_JIS = re.compile(rb"\x1b\$[@B]")
SNIFF = 4096
#: Labels that name no decoder.
REFUSED = frozenset({"replacement", "hz-gb-2312", "iso-2022-cn", "iso-2022-kr"})


def hint_from_label(label: str) -> str:
    """The decoder's name for an encoding label; unknown and refused labels are errors."""
    clean = label.strip().lower()
    if clean in REFUSED:
        raise ValueError(f"unsupported encoding {label!r}")
    try:
        return codecs.lookup({"ansi": "windows-1252", "latin1": "windows-1252", "ascii": "windows-1252", "iso-8859-1": "windows-1252"}.get(clean, clean)).name
    except LookupError:
        raise ValueError(f"unknown encoding {label!r}") from None


def _name(codec: str) -> str:
    return {"utf-8": "UTF-8", "utf-16-le": "UTF-16LE", "utf-16-be": "UTF-16BE", "cp1252": "windows-1252", "shift_jis": "Shift_JIS", "iso2022_jp": "ISO-2022-JP", "euc_jp": "EUC-JP", "gb18030": "GB18030", "gbk": "GBK", "big5": "Big5", "euc_kr": "EUC-KR"}.get(codecs.lookup(codec).name, codec)


def sniff_utf16(data: bytes) -> str | None:
    """UTF-16 without a mark: zero bytes on one side only, and a strict decode without control characters."""
    head = np.frombuffer(data[: SNIFF & ~1], np.uint8)
    head = head[: len(head) & ~1]
    if len(head) < 4 or len(data) % 2:
        return None
    even, odd = (head[0::2] == 0).mean(), (head[1::2] == 0).mean()
    for name, high, low in (("UTF-16LE", odd, even), ("UTF-16BE", even, odd)):
        if high > 0.3 and low < 0.05:
            try:
                text = data.decode(name)
            except UnicodeDecodeError:
                continue
            if not re.search(r"[\x00-\x08\x0e-\x1f]", text):
                return name
    return None


def is_binary(data: bytes, hint: str | None = None) -> bool:
    return b"\0" in data and not any(data.startswith(b) for b, _ in _BOMS) and not (hint or "").lower().startswith("utf-16") and sniff_utf16(data) is None


def decode(data: bytes, hint: str | None = None) -> Decoded:
    for bom, name in _BOMS:
        if data.startswith(bom):
            body = data if name == "UTF-8" else data[len(bom) :]
            return _strict(body, name)
    if hint:
        return _strict(data, hint_from_label(hint))
    wide = sniff_utf16(data)
    if wide:
        return Decoded(data.decode(wide), wide, False)
    if _JIS.search(data) and max(data, default=0) < 128:
        try:
            return Decoded(data.decode("iso2022_jp"), "ISO-2022-JP", False)
        except UnicodeDecodeError:
            pass
    try:
        return Decoded(data.decode("utf-8"), "UTF-8", False)
    except UnicodeDecodeError:
        text = data.decode("cp1252", "replace")
        return Decoded(text, "windows-1252", "�" in text)


def _strict(data: bytes, codec: str) -> Decoded:
    try:
        return Decoded(data.decode(codec), _name(codec), False)
    except UnicodeDecodeError:
        return Decoded(data.decode(codec, "replace"), _name(codec), True)
