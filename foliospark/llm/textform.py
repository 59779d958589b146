"""Characters that look alike or can't be seen, and one consistent form for texts that hold them."""

from __future__ import annotations

import functools
import re
import unicodedata

# Look-alike letters of other scripts and the Latin letters they look like.
CYRILLIC = dict(zip("аеорсухіјѕһԁԛԝӏАВЕКМНОРСТУХІЈЅԚԜҮ", "aeopcyxijshdqwlABEKMHOPCTYXIJSQWY"))
GREEK = dict(zip("οΟΑΒΕΖΗΙΚΜΝΡΤΥΧνραικυϲϳϹͿ", "oOABEZHIKMNPTYXvpaikucjCJ"))
OTHER = dict(zip("օոսհցյıɑɡʋᴄᴏᴠᴡᴢᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏢᏔᏚᏙᏞᏟᏦᏴ", "onuhgjiagucovwzDRTAJEWMHGZPWSVLCKB"))
TO_LATIN = CYRILLIC | GREEK | OTHER
TO_CYRILLIC = {v: k for k, v in CYRILLIC.items()}
TO_GREEK = {v: k for k, v in GREEK.items()}
# Signs that are drawn as hyphens.
HYPHENS = "‐‑‒–−﹘﹣－­"[:-1]
#: Raised, lowered, circled signs and fractions differ from plain characters to the eye; № is no "No".
KEEP = ("<super>", "<sub>", "<fraction>", "<circle>")

_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ\U000e0000-\U000e0fff]")
_BLANK = re.compile(r"\s")


def is_invisible(ch: str) -> bool:
    return bool(_INVISIBLE.match(ch)) or (unicodedata.category(ch) in ("Cf", "Cc") and not _BLANK.match(ch))


class Fold(dict):
    """For str.translate: characters to the form in which equal-looking ones agree."""

    def __missing__(self, cp: int) -> str | None:
        ch = chr(cp)
        self[cp] = to = self._of(ch)
        return to

    @staticmethod
    def _of(ch: str) -> str | None:
        if ch == "\n":
            return ch
        if is_invisible(ch):
            return None
        if ch.isspace():
            return " "
        if ch in HYPHENS:
            return "-"
        kind = unicodedata.decomposition(ch)
        if not kind or ch == "№" or kind.startswith(KEEP):
            return ch
        if kind.startswith("<square>") and unicodedata.normalize("NFKC", ch)[-1:] in "23":
            plain = unicodedata.normalize("NFKC", ch)
            return plain[:-1] + {"2": "²", "3": "³"}[plain[-1]]
        return unicodedata.normalize("NFKC", ch) if kind.startswith("<") else unicodedata.normalize("NFC", ch)


FOLD = Fold()
_DROPPED = re.compile(f"{_INVISIBLE.pattern}|[\u0300-\u036f\x00-\x08\x0e-\x1b\x7f-\x84\x86-\x9f\xad]")


class One(dict):
    """For str.translate: single characters to single characters, look-alike letters to Latin ones on request."""

    def __init__(self, latin: bool):
        super().__init__()
        self.latin = latin

    def __missing__(self, cp: int) -> str:
        ch = chr(cp)
        to = FOLD[cp]
        to = to if to is not None and len(to) == 1 else ch
        self[cp] = to = TO_LATIN.get(to, to) if self.latin else to
        return to


ONE, ONE_LATIN = One(False), One(True)


def _class_of(changes) -> str:
    """A character class of all code points for which ``changes`` holds; those beyond the basic plane are all in it."""
    hit = [cp for cp in range(0x10000) if not 0xD800 <= cp < 0xE000 and changes(cp)]
    runs: list[list[int]] = []
    for cp in hit:
        if runs and runs[-1][1] == cp - 1:
            runs[-1][1] = cp
        else:
            runs.append([cp, cp])
    return "[" + "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in runs) + "\U00010000-\U0010ffff]"


@functools.cache
def _changed(kind: str) -> re.Pattern:
    """The characters that a translation changes, so that only these are looked up."""
    table: dict = {"fold": FOLD, "one": ONE, "latin": ONE_LATIN}[kind]
    return re.compile(_class_of(lambda cp: table[cp] != chr(cp)) + ("+" if kind == "fold" else ""))


def _translated(text: str, kind: str) -> str:
    if kind == "fold":
        return _changed(kind).sub(lambda m: m[0].translate(FOLD), text)
    table = ONE_LATIN if kind == "latin" else ONE
    return _changed(kind).sub(lambda m: table[ord(m[0])], text)
_TOKEN = re.compile(r"(?:(?![⁰-₟²³¹¼-¾ªº])[^\W\d_][̀-ͯ]*)+")


def fold(text: str) -> str:
    """``text`` without invisible characters, with one kind of blank and hyphen, composed accents and plain forms of
    full-width, joined and unit signs. Raised and lowered signs stay. Look-alike letters are left to ``repair``."""
    if text.isascii() and "\t" not in text and "\r" not in text:
        return text.strip()
    return unicodedata.normalize("NFC", _translated(text, "fold")).strip()


def script(ch: str) -> str:
    cp = ord(ch)
    if cp < 0x250 or 0x1E00 <= cp < 0x1F00:
        return "L"
    if 0x370 <= cp < 0x400:
        return "G"
    if 0x400 <= cp < 0x530:
        return "C"
    return "O"


def _convert(token: str, to: str) -> str | None:
    """``token`` with all its letters in script ``to``; None where a letter has no look-alike there."""
    table = {"L": TO_LATIN, "C": TO_CYRILLIC, "G": TO_GREEK}[to]
    out = []
    for ch in token:
        if unicodedata.category(ch)[0] == "M" or script(ch) == to and ch not in OTHER:
            out.append(ch)
        elif (x := table.get(ch)) is not None:
            out.append(x)
        else:
            base = unicodedata.normalize("NFD", ch)
            if len(base) > 1 and (x := table.get(base[0])) is not None:
                out.append(unicodedata.normalize("NFC", x + base[1:]))
            else:
                return None
    return "".join(out)


_ONLY_CYRILLIC = re.compile("[бгджзийлпфцчшщъыьэюя]")
_SUSPECT = re.compile("[Ͱ-ԯա-ևıɑɡʋᴄᴏᴠᴡᴢᎠ-Ᏼ]")


def candidates(folded: str) -> list[tuple[str, list[str]]]:
    """(token, repaired forms in order of preference) of the tokens that mix scripts, or whose look-alike letters stand
    out from the script of the whole text."""
    if not _SUSPECT.search(folded):
        return []
    # Letters without a look-alike tell the script of the text; the others count only between equals.
    counts = {"L": 0.0, "C": 0.0, "G": 0.0, "O": 0.0}
    tokens = _TOKEN.findall(folded)
    for t in tokens:
        for ch in t:
            counts[script(ch)] += 1e-6 if ch in TO_LATIN or ch in TO_CYRILLIC or ch in TO_GREEK else 1
    main = max("LCG", key=lambda s: counts[s])
    out = []
    for t in dict.fromkeys(tokens):
        own = {s: 0 for s in "LCGO"}
        for ch in t:
            own[script(ch)] += 1
        if own["O"] and not any(ch in OTHER for ch in t):
            continue
        seen = [s for s in "LCG" if own[s]]
        if len(seen) < 2 and seen == [main] and not any(ch in OTHER for ch in t):
            continue
        order = sorted("LCG", key=lambda s: (s != main, -own[s])) if len(seen) > 1 else [main]
        forms = [f for s in order if (f := _convert(t, s)) is not None and f != t]
        if forms:
            out.append((t, list(dict.fromkeys(forms))))
    return out


def repair(folded: str, vocabulary) -> str:
    """``folded`` with its mixed-script tokens in one script, where the result is a word of ``vocabulary`` (lower case)."""
    found = candidates(folded)
    if not found:
        return folded
    swap = {t: f for t, forms in found for f in forms[::-1] if f.lower() in vocabulary}
    return _TOKEN.sub(lambda m: swap.get(m[0], m[0]), folded) if swap else folded


#: Letters of two scripts in one word, maybe with letters of others and accents between.
_MIXED = re.compile("[A-Za-zÀ-ÖØ-öø-\u024f\u1e00-\u1eff][\u0300-\u036f\u0250-\u02af\u0531-\u058f\u13a0-\u13f5]*[\u0370-\u052f]|[\u0370-\u03ff][\u0300-\u036f\u0250-\u02af\u0531-\u058f\u13a0-\u13f5]*[A-Za-zÀ-ÖØ-öø-\u024f\u1e00-\u1eff\u0400-\u052f]|[\u0400-\u052f][\u0300-\u036f\u0250-\u02af\u0531-\u058f\u13a0-\u13f5]*[A-Za-zÀ-ÖØ-öø-\u024f\u1e00-\u1eff\u0370-\u03ff]")


def skeleton(text: str) -> tuple[str, list[int]]:
    """A Latin-letter rendering of ``text`` for rules written in plain characters, and the place of each of its characters
    in ``text``. Invisible characters are left out; all others stand for one character each."""
    if text.isascii():
        return text, []
    mixed = bool(_SUSPECT.search(text)) and len(_ONLY_CYRILLIC.findall(text)) < 3 and bool(_MIXED.search(text))
    if not _DROPPED.search(text):
        return _translated(text, "latin" if mixed else "one"), []
    out, at = [], []
    for i, ch in enumerate(text):
        to = FOLD[ord(ch)]
        if to is None or unicodedata.category(ch) == "Mn" and ord(ch) < 0x370:
            continue
        to = to if len(to) == 1 else ch
        if mixed:
            to = TO_LATIN.get(to, to)
        out.append(to)
        at.append(i)
    return "".join(out), at
