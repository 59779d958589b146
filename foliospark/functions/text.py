"""Scalar text functions as column expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions import patterns as P


def count(c: Column, pattern: str) -> Column:
    """Matches of ``pattern`` in ``c`` as BIGINT; 0 for null."""
    return F.coalesce(F.regexp_count(c, F.lit(pattern)), F.lit(0)).cast("long")


def strip(c: Column) -> Column:
    """``c`` without white space of any kind at its ends."""
    return F.btrim(c, F.lit(P.SPACES))


def squeeze(c: Column) -> Column:
    """``c`` with every run of white space as one blank, and none at the ends."""
    return strip(F.regexp_replace(c, rf"[{P.SPACE}]+", " "))


def without_placeholder(c: Column) -> Column:
    return F.replace(c, F.lit(P.PLACEHOLDER), F.lit(" "))


def word_count(c: Column) -> Column:
    return count(without_placeholder(c), P.WORD)


def words(c: Column) -> Column:
    """English words in order; the formula placeholder is none."""
    return F.regexp_extract_all(without_placeholder(c), F.lit(f"({P.WORD})"), 1)


def letter_token_count(c: Column) -> Column:
    return count(without_placeholder(c), f"[{P.LETTER}]+")


def tokens(c: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.transform(F.regexp_extract_all(without_placeholder(c), F.lit(f"({P.TOKEN})"), 1), F.lower)


def chemical_tokens(c: Column) -> Column:
    """The distinct tokens that look like chemical formulas."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(f"({P.CHEMICAL})"), 1))


def format_traces(c: Column) -> Column:
    """MAP of the kinds of sub- and superscript notation in ``c`` to their counts; kinds without any are left out."""
    kinds = F.map_from_arrays(F.array(*map(F.lit, P.TRACES)), F.array(*[count(c, p).cast("int") for p in P.TRACES.values()]))
    return F.map_filter(kinds, lambda _, n: n > 0)


def broken_glyphs(c: Column) -> Column:
    return count(c, P.BROKEN_GLYPH)


def repair_glyphs(c: Column) -> tuple[Column, Column]:
    """(text, number of repairs): broken ligatures and symbols of known fonts, only where the text shows their signature."""
    broken = c.rlike(P.GLYPH_SIGNATURE)
    fixed, n = c, F.lit(0).cast("long")
    for bad, good in P.LIGATURES.items():
        fixed = F.replace(F.regexp_replace(fixed, rf"(?<=[A-Za-z]) ?{bad} ?(?=[a-z])", good), F.lit(bad), F.lit(good))
        n = n + count(c, bad)
    for bad, good in P.SYMBOLS.items():
        fixed = F.replace(fixed, F.lit(bad), F.lit(good))
        n = n + count(c, bad)
    return F.when(broken, fixed).otherwise(c), F.when(broken, n).otherwise(F.lit(0).cast("long"))


def lines(c: Column) -> Column:
    """The lines of ``c`` by any of the three line ends; an empty text is one empty line."""
    return F.split(F.regexp_replace(c, "\r\n?", "\n"), "\n", -1)


def is_equation_line(c: Column) -> Column:
    return c.rlike(P.EQUATION) & ~without_placeholder(c).rlike(P.PROSE_WORD)


def is_named_heading(c: Column) -> Column:
    bare = F.regexp_replace(strip(c), P.NUMBER_PREFIX, "")
    short = bare.rlike(P.BACK_START) & (word_count(bare) <= 4) & ~bare.rlike(r"[.;,]\z")
    return bare.rlike(P.NAMED_HEADING) | F.regexp_replace(bare, "[ :]+$", "").rlike(P.BACK_WHOLE) | short


def is_heading_line(c: Column) -> Column:
    rest = F.regexp_replace(c, rf"^[{P.SPACE}]*[^{P.SPACE}]+[{P.SPACE}]+", "")
    numbered = c.rlike(P.NUMBERED_HEADING) & (word_count(c) <= 10) & ~rest.rlike(P.FINITE_VERB) & ~rest.rlike(P.TRAILING_WORD) & (count(rest, P.NUMERIC_TOKEN) < 2)
    return is_named_heading(c) | numbered  # either holds at least one word


def is_back_heading(c: Column) -> Column:
    """A named heading that opens back matter."""
    return is_named_heading(c) & c.rlike(P.BACK_START)


def chunk_count(c: Column) -> Column:
    """Runs without white space."""
    return count(c, rf"[^{P.SPACE}]+")


def is_figure_text(c: Column) -> Column:
    """Axis ticks and legends: six chunks or more, many numbers, hardly a function word, no full stop at the end."""
    n = chunk_count(c)
    plain = F.regexp_replace(c, r"\([a-z]\)", " ")
    stop = count(plain, P.STOP_TOKEN) / F.greatest(word_count(plain), F.lit(1))
    return ~c.rlike(r"[.;]\z") & (n >= 6) & (count(c, P.NUMERIC_TOKEN) >= 0.3 * n) & (stop < 0.1)


def subfields(title: Column, abstract: Column, keywords: dict[str, tuple[str, ...]] | None = None) -> Column:
    """The subfields of which a keyword begins a word of title or abstract, in the order of the dictionary."""
    text = F.lower(F.concat_ws(" ", title, abstract))
    hits = [F.when(text.rlike(rf"(?U)\b(?:{'|'.join(map(_literal, ks))})"), F.lit(k)) for k, ks in (keywords or P.SUBFIELDS).items()]
    return F.array_compact(F.array(*hits))


def _literal(s: str) -> str:
    return "".join(ch if ch.isalnum() or ch == " " else "\\" + ch for ch in s)


def sentences(c: Column) -> Column:
    """Sentences split behind a stop before a capital or bracket, and joined again behind abbreviations."""
    pieces = F.split(strip(c), P.SENTENCE_BREAK)
    keep_open = lambda acc: F.element_at(acc, -1).rlike(P.ABBREVIATION_END)

    def add(acc: Column, x: Column) -> Column:
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat_ws(" ", F.element_at(acc, -1), x)))
        return F.when((F.size(acc) > 0) & keep_open(acc), joined).when(x != "", F.concat(acc, F.array(x))).otherwise(acc)

    return F.aggregate(pieces, F.array().cast("array<string>"), lambda acc, x: F.when(F.size(acc) == 0, F.when(x != "", F.array(x)).otherwise(acc)).otherwise(add(acc, x)))


def split_output(c: Column, k: Column) -> Column:
    """The ``k`` paragraphs of a model's answer; null where it has another number of them."""
    parts = F.filter(F.transform(F.split(strip(c), r"\n\s*\n"), squeeze), lambda p: p != "")
    return F.when(F.size(parts) == k, parts)


def pdf_loc(c: Column) -> Column:
    """STRUCT<page, first, last> of a location by page and lines; null for others."""
    part = lambda n: F.regexp_extract(c, P.PDF_LOC, n).cast("int")
    return F.when(c.rlike(P.PDF_LOC), F.struct(part(1).alias("page"), part(2).alias("first"), part(3).alias("last")))


def running_key(c: Column) -> Column:
    """A line without digits and blanks, in lower case: headers and footers compare by it."""
    return F.lower(F.regexp_replace(c, rf"[\p{{Nd}}{P.SPACE}]+", ""))
