"""Regular expressions and word lists. All patterns are in the dialect of ``java.util.regex``.

``\\s``, ``.`` and ``$`` of that dialect know ASCII only; the classes here spell out what is meant.
"""

# Fixed values -------------------------------------------------------------------------------------
PLACEHOLDER = "[FORMULA]"
STOPWORDS = "the of and to in a is that for with as by on are this was be from at an or which were it can".split()
FOREIGN_WORDS = (
    "der die und nicht ist mit von sich das "
    "les des une est sont dans pour avec "
    "che della sono nella degli delle il di "
    "los las del una para como por que el"
).split()
MATH_WORDS = "exp sin cos tan log ln max min lim sinh cosh tanh".split()
FINITE_VERBS = "is are was were has have had be been can could may will would shows? showed".split()
TRAILING_WORDS = "the a an of and or to in for with at by on from".split()
ABBREVIATIONS = ("et al", "e.g", "i.e", "Fig", "Figs", "Eq", "Eqs", "Ref", "Refs", "vs", "ca", "approx", "No")
NAMED_SECTIONS = ("abstract", "introduction", "conclusions?", r"results(?:\s+and\s+discussion)?", "discussion", r"experimental(?:\s+section)?", r"materials\s+and\s+methods", "methods", "methodology", "keywords?")
BACK_SECTIONS = (
    "acknowledge?ments?", r"author\s+contributions?", r"credit\s+authorship", "funding", r"conflicts?\s+of\s+interests?", r"declaration\s+of\s+competing\s+interests?", r"competing\s+interests?",
    r"data\s+availability(?:\s+statement)?", r"institutional\s+review\s+board\s+statement", r"informed\s+consent\s+statement", "nomenclature", "abbreviations", r"supplementary\s+materials?", r"supporting\s+information",
    "footnotes", r"(?:research\s+|animal\s+)?ethics\s+statement", r"fieldwork\s+statement",
)
REFERENCE_TITLES = ("references", "bibliography", r"literature\s+cited", r"참고\s*문헌")
BACK_SECTION_TYPES = ("glossary", "ack", "fn-group", "associated-data", "supplementary-materials", "COI-statement")
LIGATURES = {"": "fi", "": "fl", "": "ft"}
SYMBOLS = {"/C0": "−", "/C14": "°", "¼": "="}
SUBFIELDS = {
    "reaction_engineering": ("reactor", "kinetic", "reaction rate", "conversion", "residence time"),
    "separation": ("distillation", "adsorption", "adsorbent", "membrane", "separation", "extraction", "absorption", "crystallization", "filtration"),
    "process_systems": ("process simulation", "process design", "optimization", "techno-economic", "scale-up", "aspen", "life cycle"),
    "transport": ("mass transfer", "heat transfer", "diffusion", "fluid", "flow"),
    "catalysis": ("catalyst", "catalytic", "catalysis"),
    "materials_synthesis": ("synthesis", "synthesized", "fabrication", "nanoparticle", "composite"),
    "electrochemistry": ("electrochemical", "electrode", "battery", "electrolysis", "fuel cell"),
    "bioprocess": ("fermentation", "bioprocess", "enzyme", "bioreactor", "microbial", "biomass"),
}
KINDS = ("heading", "body", "formula", "table", "caption", "figure_text", "back_matter", "front_matter", "reference")
ACTS = ("generation", "rewriting", "proofreading", "translation", "machine_translation", "mixed", "human_edited_ai", "quoted_ai_output", "search_ideation", "unknown")
STAGES = {
    "body": ("generation", "rewriting", "mixed", "human_edited_ai"),
    "ai_translation": ("translation",),
    "machine_translation": ("machine_translation",),
    "ai_polishing": ("proofreading",),
}
BASES = ("A", "B", "C", "D")
STATUSES = ("completed", "partial", "extraction_failed", "too_short", "out_of_scope")
ROLES = ("seed", "variant", "analysis")
PLANNED_ACTS = ("generation", "rewriting", "proofreading", "translation", "mixed")
MIN_WORDS, MIN_STOP, MAX_FOREIGN, MAX_NON_LATIN = 300, 0.04, 0.05, 0.3
TARGET_PARAGRAPHS, TARGET_WORDS = 3, 60
# --------------------------------------------------------------------------------------------------

# Building blocks of the patterns. The patterns themselves, below, are fixed values too: what they match is the result.

#: All white space of Unicode, as a class body.
SPACE = r"\s\x1c-\x1f\x85   -     　"
#: The same characters one by one.
SPACES = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
LETTER = r"\p{L}\p{Nl}\p{No}"
WORD = r"[A-Za-z][A-Za-z\-']*"
TOKEN = "[A-Za-z0-9]+"


def whole_word(words: list[str]) -> str:
    """Any of ``words``, whatever its case, as a token of letters of any script."""
    return rf"(?iu)(?<![{LETTER}])(?:{'|'.join(words)})(?![{LETTER}])"


# Patterns ---------------------------------------------------------------------------
STOP_TOKEN, FOREIGN_TOKEN = whole_word(STOPWORDS), whole_word(FOREIGN_WORDS)
#: A letter token that holds a character beyond ASCII.
NON_ASCII_TOKEN = rf"[A-Za-z]*+[{LETTER}&&[^\x00-\x7f]][{LETTER}]*"
NUMERIC = r"[(\[]?[-−+]?\p{Nd}[\p{Nd}.,:/×%−-]*[)\]]?"
NUMERIC_TOKEN = rf"(?<![^{SPACE}])(?:{NUMERIC})(?![^{SPACE}])"
TRACES = {
    "unicode_subsup": "[⁰-₟²³¹]",
    "latex": r"\$[^$\n]{0,60}?[_^][^$\n]{0,60}?\$|\\[(\[]|[_^]\{[^}\n]{1,20}\}|\\(?:mathrm|text|frac|cdot|times)\b",
    "markup": r"</?su[bp]>|~\p{Nd}{1,3}~|\^\p{Nd}{1,3}\^",
}
BROKEN_GLYPH = r"[\p{Co}\p{Cn}\p{Cs}�□]|[\p{Cc}&&[^\n\r\t\f]]"
LIGATURE = "[ﬀ-ﬆ]"
CHEMICAL = r"(?<![A-Za-z0-9])[A-Z][A-Za-z]*[0-9][A-Za-z0-9]*"
PLAIN_FORMULA = r"\b(?:[A-Z][a-z]?\p{Nd}+)+(?:[A-Z][a-z]?\p{Nd}*)*\b"
CAPTION = rf"^(Fig\.?|Figure|Scheme|Table|FIG\.?|FIGURE|SCHEME|TABLE)[{SPACE}]*(?:\p{{Nd}}+|[IVX]+)[.:]?[{SPACE}]+[A-Z(]"
EQUATION = rf"(?d)=.*\(\p{{Nd}}{{1,3}}[a-z]?\)[{SPACE}]*$"
EQUATION_THEN_TEXT = rf"(?d)^(.*=.*?\(\p{{Nd}}{{1,3}}[a-z]?\))[{SPACE}]+((?:where|in which|with|here)\b.*)$"
EQUATION_LIKE = r"=[^=]*\(\p{Nd}{1,3}[a-z]?\)"
#: A word of four letters or more that is neither an acronym nor the name of a function.
PROSE_WORD = rf"(?<![A-Za-z\-'])(?!(?i:{'|'.join(MATH_WORDS)})(?![A-Za-z\-']))(?=[A-Za-z\-']*[a-z])[A-Za-z][A-Za-z\-']{{3,}}"
NUMBER_PREFIX = rf"^(?:\p{{Nd}}{{1,2}}(?:\.\p{{Nd}}{{1,2}}){{0,3}}\.?|[IVX]{{1,4}}\.)[{SPACE}]+"
NUMBERED_HEADING = rf"(?d)^(?:\p{{Nd}}{{1,2}}(?:\.\p{{Nd}}{{1,2}}){{0,3}}\.?|[IVX]{{1,4}}\.)[{SPACE}]+[A-Z][^.!?]{{0,80}}$"
_BACK = "|".join(BACK_SECTIONS)
NAMED_HEADING = rf"(?id)^(?:{'|'.join(NAMED_SECTIONS)})[{SPACE}]*:?[{SPACE}]*$"
BACK_WHOLE = rf"(?id)^(?:{_BACK})$"
BACK_START = rf"(?i)^(?:{_BACK})\b"
BACK_LABEL = rf"(?i)^(?:{_BACK})\b[^:.]{{0,40}}:"
ABSTRACT_LABEL = rf"(?i)^abstract[{SPACE}]*[:.—–-]"
REFERENCE_HEADING = rf"(?id)^[{SPACE}]*(?:\p{{Nd}}+\.?[{SPACE}]*)?(?:{'|'.join(REFERENCE_TITLES)})[{SPACE}]*$"
FINITE_VERB = rf"(?i)\b(?:{'|'.join(FINITE_VERBS)})\b"
TRAILING_WORD = rf"(?id)\b(?:{'|'.join(TRAILING_WORDS)})[{SPACE}]*$"
INTRODUCTION = rf"(?i)^[{SPACE}]*(?:\p{{Nd}}+\.?[{SPACE}]*)?introduction\b"
GLYPH_SIGNATURE = "[-]|/C0|/C14"
LINE_NUMBER = rf"^[{SPACE}]*(\p{{Nd}}{{1,4}})[{SPACE}]+(?=[^{SPACE}])"
PDF_LOC = r"^p(\p{Nd}+):L(\p{Nd}+)-(\p{Nd}+)$"
NOTICE = rf"(?i)^[{SPACE}]*(?:expression of concern|retraction|retracted|correction|corrigendum|erratum|withdrawn)"
SENTENCE_BREAK = rf"(?<=[.!?])[{SPACE}]+(?=[A-Z\[(])"
ABBREVIATION_END = rf"(?id)\b(?:{'|'.join(a.replace('.', chr(92) + '.') for a in ABBREVIATIONS)})\.$"
