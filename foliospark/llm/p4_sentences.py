"""Sentence boundaries by cascading segmentation rule tables.

A rule is a pair of regular expressions, for the text before and after a position, and says whether a
sentence may end there. The ordered table of a text's script is run through, then that of its language,
then the general one; the first rule that matches decides the position.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm import textform
from foliospark.sources.tables import table

# Abbreviations that don't end a sentence, per language.
ABBREVIATIONS = {
    "en": "e.g i.e vs cf al Dr Mr Mrs Ms Prof Fig Figs Eq Eqs Ref Refs Sec Secs Ch Vol No Nos Tab approx ca St Jr Sr viz resp wt vol ed eds pp Mt Rev Gen",
    "de": "z.B z bzw ca vgl Abb Tab Gl u.a u.Ä u o d.h d Dr Prof Nr Str S Kap sog ggf evtl inkl usf Bd Hrsg Fr Hr",
    "fr": "p.ex ex p cf fig tab no nos M Mme Mlle MM Dr Pr éq env réf chap vol art",
    "es": "p.ej p ej núm núms Dr Dra Sr Sra fig figs tab ec ecs aprox cap vol pág págs Ud Uds n",
    "it": "ad.es es dott sig ing prof fig figg tab eq n nn cap vol pag ca cfr c.d",
    "pt": "p.ex p ex fig figs tab eq n.º n núm Dr Dra Sr Sra Prof cap vol pág aprox",
    "nl": "bijv bv d.w.z z.o.g o.a m.b.t ca nr afb fig tab vgl dr prof ir mw dhr vlg blz resp t.o.v i.p.v enz",
    "ru": "напр т.е т.к т.д т.п т е к см рис табл ур г гг др им проф акад тыс млн руб стр с ср гл п пп",
    "hi": "डॉ श्री सुश्री प्रो चित्र सं",
    "ko": "Fig No vs cf",
}
# Words after which a full stop belongs to the abbreviation, yet a capital starts a new sentence.
ENDING_ABBREVIATIONS = "etc Inc Ltd Co Corp LLC usw enz ecc и.др т.д т.п a.m p.m"
# Month names, before which a short number with a full stop is a German ordinal.
MONTHS = "Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember"
# Words that open a Thai clause; Thai has no full stop, a blank before them separates sentences.
THAI_OPENERS = "ดังนั้น|เมื่อ|เรา|ค่า|งานวิจัย|วัสดุ|อย่างไรก็ตาม|นอกจากนี้|ทั้งนี้|เนื่องจาก|สำหรับ|จากการ|ในการ|การศึกษา|การทดลอง|ผลการ|พบว่า|โดยทั่วไป|ต่อมา|สุดท้าย|แต่|ถ้า|หาก|ขั้นตอน|กระบวนการ|ตัวอย่าง|สามารถ|บทความ|รูปที่|ตารางที่"

CLOSERS = "\"'”’»)\\]）」』】›“‹"
#: Positions that the rules are asked about: behind stops and what closes them, at line breaks, and at Thai blanks.
_ASK = re.compile(rf"(?:[!?…。।॥։؟۔።။]|\.(?!\d))+(?:[{CLOSERS}*_]|\s?»)*|\n")
_ASK_OF = {
    "th": re.compile(r"(?<=[\u0e00-\u0e7fA-Za-z0-9%/³²)])[ \xa0]+(?=[\u0e00-\u0e7f])|" + _ASK.pattern),
    "zh": re.compile(r"(?:[!?…。｡！？।]|\.(?!\d))+[”’」』】）)\]\"']*|\n"),
}
_ASK_OF["ja"] = _ASK_OF["zh"]
_ASK_OF["el"] = re.compile(";(?=\\s)|" + _ASK.pattern)
_BEFORE, _AFTER = 20, 32  # characters that a rule may look at on each side


def _abbr(words: str) -> str:
    forms = sorted({re.escape(w).replace(r"\.", r"\.\s?") for w in words.split()}, key=len, reverse=True)
    return rf"(?:^|[\s.(\[{{„“\"«'/>\-–—　-鿿가-힯])(?:{'|'.join(forms)})\.$"


# A rule: (ends a sentence?, text before, text after). Both patterns touch the position.
_UPPER = r"[\"'„“«‘¿¡(\[{*_|<\\>#-]*\s?(?:[A-ZÀ-ÖØ-ÞĀ-ŽЀ-ЯΆ-ΏΑ-ΫԱ-Ֆ]|[a-z]{1,2}[A-Z]|[a-z]-[A-Z]|\|)"
RULES: dict[str, list[tuple[bool, str, str]]] = {
    **{k: [(False, _abbr(v), r"\s*[^\n]")] for k, v in ABBREVIATIONS.items()},
    "th": [
        (True, r"\s", rf"(?:{THAI_OPENERS})"),
        (False, r"\s", r"[฀-๿]"),
    ],
    "zh": [(False, r"[。！？!?｡.]+[”’」』\"]+$", r"[^\s“「『]"), (True, r"[。！？｡]+[”’」』）)]*$", r"\s*\S"), (True, r"[!?]+$", r"\s*[^\s!?.,;:)\]]")],
}
RULES["ja"] = RULES["zh"]
RULES["el"] = [(True, r";$", r"\s+[\"“«(]?[A-ZΆ-ΏΑ-Ϋ]"), (False, r";$", r"")]
RULES["de"].insert(0, (False, r"(?:^|\s)\d{1,2}[a-z]?\.$", rf"\s+(?:{MONTHS})\b"))
GENERAL: list[tuple[bool, str, str]] = [
    (True, r"\n\Z", r"[ \t]*\n"),  # an empty line
    (True, r"\n[ \t]*\n\Z", r""),
    (False, r"\n\Z", r""),  # a single line break decides nothing: the stop before it does
    (False, r"(?:^|\n)\s*(?:[>*#-]\s*)*(?:\d{1,3}|[a-zA-Z]|[ivx]{1,4})[.)]$", r"\s"),  # number of a list item
    (False, r"", r"\s*[,;:，；：、]"),
    (False, r"\d\.$", r"\d"),
    (False, rf"(?:^|[\s(\[.\-])(?<!\d\s)(?<!\d\s\s)[A-ZÀ-ÞĀ-Ž]\.$", r"\s*-?[A-ZÀ-ÞĀ-Ž][\w'’.-]"),  # initials of a name
    (True, _abbr(ENDING_ABBREVIATIONS), rf"\s*{_UPPER}"),
    (False, _abbr(ENDING_ABBREVIATIONS), r"\s*\S"),
    (False, r"[.!?…]+[\"'”’»“]+$", r"[^\s\n]"),  # a quotation that goes on, as in "…다."라고
    (False, r"[.!?…]+\s?[\"'”’»“]+$", r"\s+[a-zà-öø-ÿā-žа-я]"),
    (True, r"।$", r"\s*\S"),
    (True, r"[॥؟۔։።။][)\]\"'”’»]*$", r"\s*\S"),
    # letters of scripts without capitals: Hebrew to Arabic, Indic to Lao, Myanmar and Georgian, Ethiopic, Khmer, East Asian ones
    (True, r"[.!?…。！？][)\]\"'”’»]*$", r"\s+[\"'“‘«(\[]?[\u0591-\u06ff\u0750-\u077f\ufb1d-\ufdff\ufe70-\ufefcऀ-\u0eff\u1000-\u10ff\u1200-\u137f\u1780-\u17ff\u1c90-\u1cbf぀-ヿ㐀-鿿가-힯ᄀ-ᇿ]"),
    (True, r"[가-힣ᄀ-ᇿ]\.$", r"\s+[\d(\[]"),
    (True, rf"[.!?…]+(?:[{CLOSERS}*_]|\s?»)*$", rf"\s+{_UPPER}"),
    (True, r"[^\W\d_]{2,}[)\]]?\.$", r"\s+[\d(\[]"),
    (True, r"[!?]+[\"'”’»)]*$", r"\s+[\d(\[]"),
    (True, r"[!?]$", r"\s+[a-z]-[A-Z]"),
    (True, r"(?:[^\W_]{2}|[%⁻⁰-⁹²³¹)\]}Å°KhV]|\.\.)\.$|[!?]$", r"(?:[\"“„«(¿¡]?[A-ZÀ-ÖØ-ÞĀ-Ž](?:[a-zà-ɏ]|\s)|pH\b|[a-z]-[A-Z]|[가-힯ऀ-ॿ฀-๿])"),  # the blank is missing
    (True, r"[.!?…]$", r"\s*\n\s*(?:[^a-zà-ÿ\s]|[a-z]{1,2}[A-Z]|[a-z]-[A-Z])"),
]

_LATIN = ("en", "de", "fr", "es", "it", "pt", "nl")
# Frequent words that tell the Latin-script languages apart.
_HINTS = {
    "en": "the of and to in is was with for by as at from", "de": "der die das und nicht ist wurde mit von dem den bei", "fr": "le la les des est et dans pour avec une du été",
    "es": "el los las una que con para por del se", "it": "il della che con per sono una nel dell di", "pt": "o os uma que com para foi não na do", "nl": "het een van en de is wordt met voor op",
}
_HINT_OF = {k: set(v.split()) for k, v in _HINTS.items()}
_WORDS = re.compile(r"[^\W\d_]+")


_MARKS_OF = {w: tuple(k for k in _HINT_OF if w in _HINT_OF[k]) for k in _HINT_OF for w in _HINT_OF[k]}
_SCRIPTS = {"th": "[\u0e00-\u0e7f]", "ko": "[\uac00-\ud7af\u1100-\u11ff]", "ja": "[\u3040-\u30ff]", "zh": "[\u4e00-\u9fff]", "hi": "[\u0900-\u097f]"}
_ANY_SCRIPT = re.compile("[" + "".join(c[1:-1] for c in _SCRIPTS.values()) + "]")
_HAS = {k: re.compile(c).search for k, c in _SCRIPTS.items()}
_ALPHABETS = (("ru", re.compile("[\u0400-\u04ff]+"), "а", "я"), ("el", re.compile("[\u0370-\u03ff]+"), "ά", "ώ"))


def languages_of(text: str) -> tuple[str, str]:
    """(script table, table of the alphabet's language) for ``text``.

    The first is that of a script that the text holds at all, or blank: its rules come first and ask
    about signs of their own script only, so a foreign word doesn't take the other rules away. The
    second is Russian or Greek by most words, else a Latin-script language by frequent words.
    """
    own = ""
    if not text.isascii():
        if _ANY_SCRIPT.search(text):
            own = next(k for k, has in _HAS.items() if has(text))
    low = text.lower()
    if not text.isascii():
        for k, letters, first, last in _ALPHABETS:
            if 8 * sum(map(len, letters.findall(text))) > len(text):
                words = _WORDS.findall(low)
                if sum(1 for w in words if first <= w[0] <= last) * 2 > len(words):
                    return own, k
    hits = dict.fromkeys(_LATIN, 0)
    for w in filter(_MARKS_OF.__contains__, low.split()):
        for k in _MARKS_OF[w]:
            hits[k] += 1
    return own, max(hits, key=lambda k: (hits[k], k == "en"))


# What the last three characters before a position must be for the pattern before it to match at all. It spares the
# search and decides nothing; patterns that aren't listed are always tried.
_STOPS, _QUOTES = ".!?…。！？｡", "\"'”’»“"
_CAN = {
    r"\n\Z": lambda c: c[-1:] == "\n",
    r"\n[ \t]*\n\Z": lambda c: c[-1:] == "\n",
    r"(?:^|\n)\s*(?:[>*#-]\s*)*(?:\d{1,3}|[a-zA-Z]|[ivx]{1,4})[.)]$": lambda c: c[-1:] in ".)" and not (len(c) == 3 and c[0].isalpha() and c[1].isalpha() and not set(c[:2]) <= set("ivx")),
    r"\d\.$": lambda c: c[-1:] == "." and c[-2:-1].isdigit(),
    r"[.!?…]+[\"'”’»“]+$": lambda c: c[-1:] in _QUOTES,
    r"[.!?…]+\s?[\"'”’»“]+$": lambda c: c[-1:] in _QUOTES,
    r"।$": lambda c: c[-1:] == "।",
    r"[॥؟۔։።။][)\]\"'”’»]*$": lambda c: c[-1:] not in _STOPS and not c[-1:].isspace(),
    r"[가-힣ᄀ-ᇿ]\.$": lambda c: c[-1:] == "." and c[-2:-1] >= "\u1100",
    r"[^\W\d_]{2,}[)\]]?\.$": lambda c: c[-1:] == ".",
    r"[!?]$": lambda c: c[-1:] in "!?",
    r"[.!?…]$": lambda c: c[-1:] in ".!?…",
    rf"(?:^|[\s(\[.\-])(?<!\d\s)(?<!\d\s\s)[A-ZÀ-ÞĀ-Ž]\.$": lambda c: c[-1:] == "." and c[-2:-1].isalpha() and not (len(c) == 3 and c[0].isalnum()),
}


class Rule:
    """A rule ready to run."""

    def __init__(self, ends: bool, before: re.Pattern, after: re.Pattern):
        self.ends, self.before, self.after = ends, before.search, after.match
        self.fits = _CAN.get(before.pattern, lambda chars: True)


class AbbreviationRule(Rule):
    """A rule for abbreviations: their last two letters must stand before the full stop."""

    def __init__(self, ends: bool, before: re.Pattern, after: re.Pattern, words: str):
        super().__init__(ends, before, after)
        ends_in = set()
        for w in words.split():
            last = w.lower().split(".")[-1]
            ends_in.add(last[-2:] if len(last) > 1 else "_" + last)

        def fits(chars: str) -> bool:
            c = chars[:-1].lower()
            return chars[-1:] == "." and (c in ends_in or "_" + c[-1:] in ends_in and not (c[:1].isalpha() and len(c) > 1 and c[0] < "\u3000"))

        self.fits = fits


def cascade(*langs: str) -> list[Rule]:
    """The compiled rules for ``langs``: their own in order, the English ones, the general ones."""
    tables = [RULES.get(k, []) for k in dict.fromkeys((*langs, "en"))]
    lists = {_abbr(v): v for v in (*ABBREVIATIONS.values(), ENDING_ABBREVIATIONS)}
    own = [(r, re.IGNORECASE) for t in tables for r in t] + [(r, 0) for r in GENERAL]
    out = []
    for (ends, b, a), flags in own:
        compiled = ends, re.compile(b, flags), re.compile(a)
        out.append(AbbreviationRule(*compiled, lists[b]) if b in lists else Rule(*compiled))
    return out


class Table:
    """The rules of a script and a language, listed by the characters before a position."""

    def __init__(self, own: str, lang: str):
        self.rules, self.ask = cascade(own, lang), _ASK_OF.get(own or lang, _ASK).finditer
        self._by: dict[str, list] = {}

    def at(self, chars: str) -> list:
        """The rules that can match behind the given last three characters, in order."""
        got = self._by.get(chars)
        if got is None:
            if len(self._by) > 50_000:
                self._by.clear()
            got = self._by[chars] = [(r.ends, r.before, r.after) for r in self.rules if r.fits(chars)]
        return got


_TABLES: dict[tuple[str, str], Table] = {}
_VISIBLE = re.compile(r"[^\W_]").search


def sentence_ends(text: str | None, first: int | None = None) -> list[int]:
    """For every sentence of ``text``, or for its ``first`` ones, the number of characters up to and including its last visible one.

    Null, blank and texts without a letter or digit have none. The last sentence ends with the last
    visible character of the text. Very long texts are handled whole; rules look at most 32 characters
    to each side of a position.
    """
    if not text:
        return []
    plain, at = textform.skeleton(text)
    if not _VISIBLE(plain):
        return []
    langs = languages_of(plain)
    table = _TABLES.get(langs) or _TABLES.setdefault(langs, Table(*langs))
    rules = table.at
    last = len(plain.rstrip())
    ends: list[int] = []
    begun = 0
    for m in table.ask(plain):
        p = m.end()
        if p >= last or first is not None and len(ends) >= first:
            break
        before, after = plain[max(0, p - _BEFORE) : p], plain[p : p + _AFTER]
        for ends_here, b, a in rules(before[-3:]):
            if a(after) and b(before):
                if ends_here:
                    e = len(plain[begun:p].rstrip()) + begun
                    if e > begun and _VISIBLE(plain, begun, e):
                        ends.append(e)
                        begun = p
                break
    if first is not None and len(ends) >= first:
        ends = ends[:first]
    elif _VISIBLE(plain, begun, last):
        ends.append(last)
    elif ends:
        ends[-1] = last
    return [at[e - 1] + 1 for e in ends] if at else ends


def split_sentences(text: str | None, first: int | None = None) -> list[str]:
    """The sentences of ``text``, or its ``first`` ones, without blanks around them."""
    out, begun = [], 0
    for e in sentence_ends(text, first):
        out.append(text[begun:e].strip())
        begun = e
    return out


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def ends_of(s: pd.Series) -> pd.Series:
    return pd.Series([sentence_ends(t) for t in s], dtype=object)


def sentences(targets: DataFrame, segments: DataFrame) -> DataFrame:
    """(field, rec_id, item_no, end_pos) of every sentence of the target paragraphs and body segments.

    A record delivered twice yields its sentences once (of differing deliveries the smaller list of
    ends); rows with a null key have none.
    """
    t = targets.where("seed_id IS NOT NULL").select(F.lit("target").alias("field"), F.col("seed_id").alias("rec_id"), F.posexplode("paragraphs").alias("n", "text"))
    t = t.select("field", "rec_id", (F.col("n") + 1).alias("item_no"), "text")
    s = segments.where("kind = 'body' AND doc_id IS NOT NULL AND seg_order IS NOT NULL").select(F.lit("segment").alias("field"), F.col("doc_id").alias("rec_id"), F.col("seg_order").cast("int").alias("item_no"), "text")
    # Only positions are shuffled to drop repeated deliveries, not texts.
    ends = t.unionByName(s).where("text IS NOT NULL").select("field", "rec_id", "item_no", ends_of("text").alias("ends"))
    one = ends.groupBy("field", "rec_id", "item_no").agg(F.min("ends").alias("ends"))
    return one.select("field", "rec_id", "item_no", F.explode("ends").alias("end_pos"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(table(spark, sf_dir, "targets"), table(spark, sf_dir, "segments"))


SQL: dict[str, str] = {}
QUERIES = {"p4_found": p4_found}
