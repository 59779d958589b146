"""Markup residue in texts: found, named by notation, and turned into clean text that keeps structure.

A text is cut into leaf blocks: runs of words, and signs that may be markup, each with the blocks that
enclose it. A linear-chain conditional random field over the leaves, trained on labelled pages and
decoded by Viterbi, says of which notation each leaf is, or that it is plain text.
"""

from __future__ import annotations

import functools
import html
import pickle
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.sources.tables import table

LABELS = ("plain", "html", "markdown", "wiki", "latex")

# Signs that may be markup. The first that fits at a position makes the leaf; which notation it is of,
# if any, is decided by the field, not here.
_KINDS = {
    "comment": r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<!DOCTYPE[^>]*>|<\?xml[^>]*\?>",
    "tag": r"</?[A-Za-z][\w:.-]*(?:\s+[\w:.-]+(?:\s*=\s*(?:\"[^\"<>]*\"|'[^'<>]*'|[^\s<>\"']+))?)*\s*/?>",
    "entity": r"&(?:[A-Za-z][A-Za-z0-9]{1,31}|#\d{1,7}|#[xX][0-9A-Fa-f]{1,6});",
    "fence": r"(?m:^[ \t>]*(?:```|~~~)[\w+-]*[ \t]*$)",
    "code": r"(?P<ticks>`{1,2})(?=[^`\n])[^`\n]*[^`\n](?P=ticks)(?!`)|`[^`\n]`",
    "display": r"\$\$[^$]+\$\$",
    "math": r"\$(?![\s$\d])[^$\n]+(?<![\s\\])\$(?!\d)|\$(?![\s$])\d[^$\n]*[\\^_=][^$\n]*(?<![\s\\])\$(?!\d)|\\\((?:.+?)\\\)|\\\[(?:.+?)\\\]",
    "money": r"\$\d[\d.,]*",
    "dollars": r"\$[^$\n]+\$",
    "environment": r"\\(?:begin|end)\{[A-Za-z]+\*?\}",
    "command": r"~?\\[A-Za-z]+\*?|\{\\[a-z]+\b",
    "escape": r"\\[,;:!%&_#{}$()\[\]]",
    "wikitable": r"(?m:^[ \t]*(?:\{\|.*|\|\}|\|-.*|\|\+.*|\|[^|\n]*(?:\|\|[^|\n]*)+|![^!\n]*(?:!![^!\n]*)+|![ \t]\S[^\n]*)$)",
    "template": r"\{\{",
    "wikilink": r"\[\[|\[https?://[^\s\]]+ [^\]\n]+\]",
    "quotes": r"'{2,5}",
    "wikihead": r"(?m:^[ \t]*(?P<heads>={1,6})[ \t]*[^=\n]+?[ \t]*(?P=heads)[ \t]*$)",
    "wikiindent": r"(?m:^:{1,4}[ \t]*(?=\S))",
    "switch": r"__[A-Z]{3,}__",
    "row": r"(?m:^[ \t]*\|[^\n]*\|[ \t]*$)",
    "image": r"!\[[^\]\n]*\]\([^)\s]*(?:\s\"[^\"]*\")?\)",
    "link": r"\[[^\[\]\n]+\]\((?:https?:|#|/|\.|mailto:|\w+[./])[^)\s]*(?:\s\"[^\"]*\")?\)|\[[^\[\]\n]+\]\[[^\[\]\n]*\]|<https?://[^\s<>]+>",
    "footnote": r"\[\^[\w-]+\]:?",
    "refline": r"(?m:^[ \t]*\[[^\]\n]+\]:[ \t]+\S+)",
    "setext": r"(?m:^[ \t]*(?:={3,}|-{3,}|\*{3,})[ \t]*$)",
    "hash": r"(?m:^[ \t]*#{1,6}[ \t]+(?=\S))",
    "quote": r"(?m:^[ \t]*>+[ \t]+(?=\S))",
    "bullet": r"(?m:^[ \t]*[*+-][ \t]+(?=\S))",
    "strong": r"(?P<stars>\*{1,3})(?=[^\s*])[^*\n]*?(?<=[^\s*])(?P=stars)(?![*\d])",
    "under": r"(?<![\w\\])(?P<lines>__?)(?=[^\s_])[^_\n]*?(?<=[^\s_])(?P=lines)(?!\w)",
    "strike": r"~~(?=\S)[^~\n]*?(?<=\S)~~",
    "raised": r"(?<=[\w)])~[^~\s]+~|(?<=[\w)])\^[^\^\s]+\^",
    "braced": r"[_^]\{[^{}\n]+\}",
    "cite": r"\[\d{1,4}(?:\s*[,–-]\s*\d{1,4})*\]|\[FORMULA\]",
    "bar": r"\|[^|\n]{1,12}\|",
    "facet": r"\{[\d\s-]+\}",
    "compare": r"[<>]=?(?=\s*[\d.−-]|\s)",
    "number": r"#\d+",
    "times": r"(?<=\d)\s*\*\s*(?=\d)",
    "name": r"\b[A-Za-z]\w*_\w+\b",
    "other": r"[*~^|{}\[\]\\<>&#=`$_]",
}
_LEAF = re.compile("|".join(f"(?P<{k}>{p})" for k, p in _KINDS.items()), re.DOTALL)
#: What a text must hold to be looked at: a superset of what the field was shown as markup.
SUSPECT = (
    r"(?m:^[ \t]+[*+>|=#:`~!-])|(?=[<&*_`~'\[\]{|$\\=^#>:+-])(?:</?[A-Za-z!?]|&#?[0-9A-Za-z]{2,31};|&#[0-9];|\*{1,3}(?=[^\s\d*])|\*\d[^*\n]*(?<=[^\s*])\*(?!\d)|`|~~|~\S+~|~\\|''|\[\[|\[https?:|\]\(|\]\[|\[\^|\]:|\{\||\|\}|\{\{|\|\||\|:?-|"
    r"\$\$|\$(?=[^\s\d])|\$[^$\n]*[\\_^=][^$\n]*\$|\$[^$\n]+\$|\\[A-Za-z(\[,;:!%&_#{}$]|\{\\|[_^]\{|\^\S+\^|__[^\s_]|(?m:^[ \t]*(?:[*+>-]|#{1,6}|:{1,4})[ \t]+\S)|(?m:^:{1,4}\S)|(?m:^[ \t]*={1,6}[^=\n]+=)|(?m:^[ \t]*(?:={3,}|-{3,}|\*{3,})[ \t]*$)|(?m:^[ \t]*\|)|(?<![\w\\])_(?=[^\s_]))"
)


_PAIRS = {"{{": "}}", "[[": "]]", "{": "}"}
_DOUBLE = re.compile(r"\{\{|\}\}|\[\[|\]\]")
_SINGLE = re.compile(r"\\.|[{}]", re.DOTALL)


def _closed(text: str, signs: re.Pattern) -> dict[int, int]:
    """Where brackets that open at a position are closed again (behind the closing one), by one pass with a stack."""
    out: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    for m in signs.finditer(text):
        sign = m[0]
        if sign in _PAIRS:
            stack.append((_PAIRS[sign], m.start()))
        elif any(want == sign for want, _ in stack[-4:]):
            while stack:
                want, at = stack.pop()
                if want == sign:
                    out[at] = m.end()
                    break
    return out


def leaves(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the leaf blocks of ``text`` in order; words between signs are of kind "words".

    Templates, links of a wiki and arguments of commands reach to their closing bracket, whatever is
    nested in them and however long they are; an opening one that is never closed is a sign of its own.
    """
    out, at = [], 0
    double = _closed(text, _DOUBLE) if "{{" in text or "[[" in text else {}
    braces: dict[int, int] | None = None
    search = _LEAF.search
    while m := search(text, at):
        kind, a, b = m.lastgroup, m.start(), m.end()
        if kind in ("template", "wikilink") and m[0] in _PAIRS:
            b = double.get(a, 0)
            if b <= a + 4:
                kind, b = "other", a + 1
        elif kind in ("command", "environment") and text[b : b + 1] in ("{", "[") and not m[0].startswith("{"):
            if braces is None:
                braces = _closed(text, _SINGLE)
            while b < len(text):
                if text[b] == "{" and b in braces:
                    b = braces[b]
                elif text[b] == "[" and (e := text.find("]", b)) > 0 and "\n" not in text[b:e]:
                    b = e + 1
                else:
                    break
        if a > at:
            out.append(("words", at, a))
        out.append((kind, a, b))
        at = b
    if at < len(text):
        out.append(("words", at, len(text)))
    return out


def _class(ch: str) -> str:
    return "end" if not ch else "line" if ch == "\n" else "blank" if ch.isspace() else "digit" if ch.isdigit() else "letter" if ch.isalpha() else "sign"


def features(text: str, found: list[tuple[str, int, int]]) -> list[tuple[str, ...]]:
    """Features of every leaf: its kind and shape, what touches it, and which blocks are open around it."""
    out = []
    open_blocks: list[str] = []
    fenced = False
    for i, (k, a, b) in enumerate(found):
        s = text[a:b]
        f = [k]
        if k != "words":
            left, right = _class(text[a - 1 : a]), _class(text[b : b + 1])
            inner = s.strip("$*_~`^'[]{}|()\\ \t")
            f += [f"{k} left {left}", f"{k} right {right}"]
            f.append(f"{k} holds {'math' if re.search(r'[\\_^=]', inner) else 'digits' if re.fullmatch(r'[\d.,\s–-]*', inner) else 'words' if ' ' in inner else 'word' if inner.isalpha() else 'mixed'}")
            f.append(f"{k} size {min(len(s), 40) // 10}")
            if k in ("quotes", "fence", "other", "setext", "bullet", "row", "wikitable", "wikiindent"):
                f.append(f"{k} again {any(x[0] == k for j, x in enumerate(found) if j != i)}")
            if k == "dollars":
                f += [f"dollars begin {_class(s[1:2])}", f"dollars stop {_class(s[-2:-1])}"]
            if k == "other":
                f.append(f"sign {s}")
            if k == "tag":
                f.append(f"tag {re.sub(r'[^a-z]', '', s.lower().split()[0])[:10]}")
        f += [f"{k} in {x}" for x in dict.fromkeys(open_blocks[-3:])]
        if fenced:
            f.append(f"{k} in fence")
        before = next((found[j][0] for j in range(i - 1, -1, -1) if found[j][0] != "words"), "start")
        f.append(f"{k} after {before}")
        out.append(tuple(f))
        if k == "fence":
            fenced = not fenced
        elif k == "tag" and not s.endswith("/>"):
            name = re.sub(r"[^a-z]", "", s.lower().split()[0].rstrip(">"))
            if s.startswith("</"):
                if name in open_blocks:
                    del open_blocks[len(open_blocks) - 1 - open_blocks[::-1].index(name) :]
            elif name not in ("br", "hr", "img"):
                open_blocks.append(name)
        elif k == "environment":
            if s.startswith("\\begin"):
                open_blocks.append("env")
            elif "env" in open_blocks:
                open_blocks.remove("env")
        elif k == "wikitable" and s.lstrip().startswith("{|"):
            open_blocks.append("wikitable")
        elif k == "wikitable" and s.lstrip().startswith("|}") and "wikitable" in open_blocks:
            open_blocks.remove("wikitable")
    return out


class Field:
    """A linear-chain conditional random field with sparse binary features."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, moves: np.ndarray):
        self.index, self.weights, self.moves = index, weights, moves
        self._scores: dict[tuple[str, ...], np.ndarray] = {}

    def scores(self, f: tuple[str, ...]) -> np.ndarray:
        s = self._scores.get(f)
        if s is None:
            if len(self._scores) > 100_000:
                self._scores.clear()
            s = self._scores[f] = self.weights[[i for x in f if (i := self.index.get(x)) is not None]].sum(0)
        return s

    def decode(self, fs: list[tuple[str, ...]]) -> list[int]:
        """The most probable labels, by Viterbi."""
        if not fs:
            return []
        best = self.scores(fs[0])
        back = []
        for f in fs[1:]:
            cand = best[:, None] + self.moves
            back.append(cand.argmax(0))
            best = cand.max(0) + self.scores(f)
        path = [int(best.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1]


def train(pages: list[tuple[list[tuple[str, ...]], list[int]]], rounds: int = 6, rate: float = 0.3, decay: float = 1e-4) -> Field:
    """A field fitted to (features, labels) of pages by stochastic gradient ascent on the likelihood (AdaGrad)."""
    index: dict[str, int] = {}
    coded = [([np.array([index.setdefault(x, len(index)) for x in f]) for f in fs], ys) for fs, ys in pages]
    n = len(LABELS)
    w, m = np.zeros((len(index), n)), np.zeros((n, n))
    gw, gm = np.full_like(w, 1e-3), np.full_like(m, 1e-3)
    order = list(range(len(coded)))
    rng = random.Random(5)
    for _ in range(rounds):
        rng.shuffle(order)
        for p in order:
            fs, ys = coded[p]
            e = np.array([w[f].sum(0) for f in fs])
            t = len(fs)
            a, b = np.zeros((t, n)), np.zeros((t, n))
            a[0] = e[0]
            for i in range(1, t):
                x = a[i - 1][:, None] + m
                top = x.max(0)
                a[i] = e[i] + top + np.log(np.exp(x - top).sum(0))
            for i in range(t - 2, -1, -1):
                x = m + (e[i + 1] + b[i + 1])[None, :]
                top = x.max(1)
                b[i] = top + np.log(np.exp(x - top[:, None]).sum(1))
            top = a[-1].max()
            z = top + np.log(np.exp(a[-1] - top).sum())
            node = np.exp(a + b - z)
            for i, (f, y) in enumerate(zip(fs, ys)):
                g = -node[i]
                g[y] += 1
                g = g - decay * w[f]
                gw[f] += g * g
                w[f] += rate * g / np.sqrt(gw[f])
            g = np.zeros_like(m)
            for i in range(1, t):
                g -= np.exp(a[i - 1][:, None] + m + (e[i] + b[i])[None, :] - z)
                g[ys[i - 1], ys[i]] += 1
            gm += g * g
            m += rate * g / np.sqrt(gm)
    return Field(index, w, m)


# ---------------------------------------------------------------- labelled pages

# Words, and pieces of plain text with signs in them, of which pages are made.
_WORDS = "the flow rate was measured in a stirred vessel at constant load and results were taken as stable with less heat over time when pressure rose again near an older unit that holds water".split()
_PLAIN = (
    "values of p < {n} were kept", "a ratio x > {n} was found", "at |E| > {n} V", "the norm |{w}| fell", "costs of ${n} million", "between ${n} and ${m} a year", "a grant of ${n},000", "sample #{n} broke", "run {n} * {m} tubes", "{n} * {m} cells", "as reported [{n}]",
    "see [{n},{m}] and [{n}-{m}]", "the {{111}} facets", "a set {{1, 2}}", "the parameter k_app", "a variable {w}_{w}", "[FORMULA]", "where [FORMULA] holds", "{n} < {m} < {n}", "x = {n}", "q = a P / (1 + b P)", "r = k c n exp(E/RT) ({n}b)", "A & B", "R&D costs",
    "{n} # {m}", "about ~{n} units", "~{n} %", "{n}^{m} cells", "10^{n} per ml", "a - b", "'{w}' and '{w}'", "\"{w}\"", "the {w}'s {w}", "C:\\{w}", "{w}/{w}", "{w}: {w}", "if a < b then", "{n} <= {m}", "yes | no", "[{n}a]", "[{w}]", "{w}* {n}", "({n})", "T_{n} and T_{m}", "see table {n} | {m}",
)
_MARKED = {
    "html": (
        "<b>{w}</b>", "<i>{w} {w}</i>", "<em>{w}</em>", "<STRONG>{w}</STRONG>", "<sub>{n}</sub>", "<sup>{w}</sup>", "CO<sub>2</sub>", "<a href=\"https://{w}.example/{n}\">{w}</a>", "<span class=\"{w}\">{w}</span>", "<br>", "<br/>", "<hr />", "&nbsp;", "{w}&nbsp;{w}",
        "&lt;", "&gt; {n}", "&amp;", "&alpha;", "&#176;", "&#xB0;", "<!-- {w} {n} -->", "\n<p>{w} {w}</p>\n", "\n<h2>{w}</h2>\n", "\n<ul>\n<li>{w} {w}</li>\n<li>{w}</li>\n</ul>\n", "\n<table><tr><td>{w}</td><td>{n}</td></tr></table>\n", "<div class=\"{w}\" id=\"s{n}\">\n{w} {w}\n</div>",
        "<xref ref-type=\"bibr\" rid=\"b{n}\">{n}</xref>", "<ext-link xlink:href=\"x{n}\">{w}</ext-link>", "<ref id=\"{w}\">{w}</ref>", "<img src=\"{w}.png\"/>", "<pre>{w}</pre>", "<code>{w}_{w}</code>", "<font color={w}>{w}</font>", "<italic>{w}</italic>", "<u>{w}</u>", "<script>{w}</script>",
    ),
    "markdown": (
        "**{w}**", "*{w}*", "***{w}***", "*{w} {w}*", "__{w}__", "_{w}_", "~~{w}~~", "`{w}`", "`{w}_{w}`", "`{w}({w})`", "``{w}``", "H~{n}~O", "m^{n}^", "text[^{n}]", "[{w} {w}](https://{w}.example/q{n})", "![{w}]({w}{n}.png)", "[{w} {w}][{n}a]", "[{w}]({w}.md)",
        "\n\n## {w} {w}\n\n", "\n\n# {w}\n\n", "\n\n### {w}\n\n", "\n\n{w} {w}\n==========\n\n", "\n\n{w}\n-----\n\n", "\n\n**{w} {w}**\n\n", "\n> {w} {w}\n> {w}\n", "\n\n* {w} {w}\n* {w}\n\n", "\n\n- {w} {w}\n- {w}\n\n", "\n\n+ {w}\n+ {w}\n", "\n\n```python\n{w}({n}, k_{w})\n```\n", "\n\n```\n{w}\n```\n",
        "\n\n| {w} | {w} |\n|:---|---:|\n| {n} | {n}.{m} |\n\n", "\n\n| {w} | {w} |\n|---|---|\n| {w} | {n} |\n", "\n[{w}]: https://{w}.example\n", "<https://{w}.example/{n}>", "\n[^{n}]: {w} {w}\n", "\n\n---\n\n", "\n* [FORMULA]\n", "\n> [FORMULA]\n", "\n- {n} {m}\n", "\n> {n} {w}\n> {w}\n",
    ),
    "wiki": (
        "'''{w}'''", "''{w}''", "'''''{w}'''''", "'''{w} {w}'''", "''{w} {w}''", "[[{w}]]", "[[{w} {w}|{w}]]", "[[File:{w}.png|thumb|{w} {w}]]", "[[Category:{w}]]", "{{{{{w}|{n}.{m}|u={w}}}}}", "{{{{{w} {w}}}}}", "{{{{cvt|{n}|K}}}}", "\n\n== {w} {w} ==\n\n", "\n\n=== {w} ===\n\n",
        "\n{{| class=\"wikitable\"\n! {w} !! {w}\n|-\n| {n} || {n}.{m}\n|}}\n", "\n{{|\n|-\n| {w} || {n}\n|-\n| {w} || {m}\n|}}\n", "\n:: [[{w} {w}]]\n", "\n: {w} {w}\n", "\n:: {w}\n", "__TOC__", "[https://{w}.example {w} {w}]", "\n= {w} =\n", "\n==== {w} ====\n",
    ),
    "latex": (
        "\\textbf{{{w}}}", "\\emph{{{w} {w}}}", "\\textit{{{w}}}", "{{\\bf {w}}}", "{{\\it {w}}}", "\\cite{{{w}{n}}}", "~\\cite{{{w}}}", "~\\ref{{sec:{n}}}", "\\citep[see][]{{{w}{n}}}", "\\SI{{{n}}}{{\\kelvin}}", "\\footnote{{{w} {w}}}", "\\label{{sec:{n}}}", "{n}\\%", "{n}\\,{w}", "$\\alpha$", "$x_{{i}}$",
        "H$_2$O", "$k = {n}$", "$\\approx {n}$", "$\\mathrm{{CO_2}}$", "$T$", "$n$", "$$ \\sum_i x_i = 1 $$", "\n\\[ r = k c^{{n}} \\]\n", "\\(T_{w}\\)", "\n\\begin{{equation}}\n  q = \\frac{{a P}}{{1 + b P}}\n\\end{{equation}}\n", "\n\n\\begin{{itemize}}\n\\item {w} {w}\n\\item {w}\n\\end{{itemize}}\n",
        "\n\n\\section{{{w} {w}}}\n\n", "\\subsection*{{{w}}}", "\\frac{{{n}}}{{{m}}}", "\\times {n}", "\\mu m", "$10^{{{n}}}$", "\n$$\nE = mc^2\n$$\n", "\\url{{https://{w}.example}}", "c^{{n}} and x_{{ij}}", "\\begin{{tabular}}{{ll}} {w} \\end{{tabular}}", "$p < {n}$", "\\texttt{{{w}}}", "\\ldots", "\\&", "\\noindent {w}",
    ),
}


def labelled_pages(count: int = 900, seed: int = 6) -> list[tuple[list[tuple[str, ...]], list[int]]]:
    """Pages of made-up text with known markup: (features, labels) of their leaves."""
    rng = random.Random(seed)

    def fill(t: str) -> str:
        t = re.sub(r"\{([nmw])\}", lambda m: "\0" + m[1], t.replace("{{", "\1").replace("}}", "\2"))
        t = t.replace("\1", "{").replace("\2", "}")
        return re.sub("\0([nmw])", lambda m: rng.choice(_WORDS) if m[1] == "w" else str(rng.choice((rng.randint(1, 9), rng.randint(10, 999)))), t)

    marked = [(k, t) for k, ts in _MARKED.items() for t in ts]
    pages = []
    for i in range(count):
        pieces: list[tuple[str, str]] = []
        own = rng.sample(list(_MARKED), rng.choice((0, 1, 1, 1, 2)))
        for j in range(rng.randint(2, 6)):
            pieces.append(("plain", " ".join(rng.choices(_WORDS, k=rng.randint(2, 8)))))
            if rng.random() < 0.5:
                pieces.append(("plain", fill(rng.choice(_PLAIN))))
            if own and rng.random() < 0.7:
                k = rng.choice(own)
                pieces.append((k, fill(marked[(i * 7 + j) % len(marked)][1] if marked[(i * 7 + j) % len(marked)][0] == k else rng.choice(_MARKED[k]))))
        text, spans = "", []
        for k, s in pieces:
            glue = "" if not text or s.startswith("\n") or text.endswith("\n") else " "
            text += glue
            if text.endswith("\n"):
                s = s.lstrip("\n")
            spans.append((len(text), len(text) + len(s), k))
            text += s
        found = leaves(text)
        ys = []
        for kind, a, b in found:
            k = next((k for x, y, k in spans if kind != "words" and k != "plain" and a < y and b > x), "plain")
            ys.append(LABELS.index(k))
        pages.append((features(text, found), ys))
    return pages


@functools.cache
def trained() -> Field:
    """The field fitted to the labelled pages; a few seconds, once per process."""
    return train(labelled_pages())


def notations(text: str, field: Field) -> list[str]:
    """The notations of which ``text`` holds residue."""
    found = leaves(text)
    if all(k in ("words", "cite", "money", "compare", "number", "name") for k, _, _ in found):
        return []
    return [LABELS[y] for y in sorted(set(field.decode(features(text, found)))) if y]


# ---------------------------------------------------------------- clean text


# Commands of which the argument is the text, those that only refer or lay out, and levels of headings.
_SHOWN = ("textbf", "textit", "emph", "text", "mathrm", "texttt", "textsc", "textsf", "underline", "url", "textsuperscript", "textsubscript", "mbox", "title", "author", "caption", "chem", "ce")
_SILENT = ("cite", "citep", "citet", "ref", "label", "eqref", "noindent", "centering", "hline", "toprule", "midrule", "bottomrule", "newpage", "clearpage", "bf", "it", "em", "rm", "sf", "tt", "small", "large")
_LEVELS = {"chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4}
_BLOCKS = ("p", "div", "br", "hr", "tr", "ul", "ol", "table", "title", "sec", "section", "article", "blockquote", "figure", "figcaption", "caption", "dl", "dt", "dd")
_LISTS = {"ul": "- ", "itemize": "- ", "description": "- ", "ol": "1. ", "enumerate": "1. "}


def _split_top(s: str, sign: str = "|") -> list[str]:
    """``s`` cut at signs that stand in no bracket."""
    out, depth, begun = [], 0, 0
    for m in re.finditer(r"\{\{|\[\[|\}\}|\]\]|" + re.escape(sign), s):
        if m[0] in ("{{", "[["):
            depth += 1
        elif m[0] in ("}}", "]]"):
            depth -= 1
        elif depth == 0:
            out.append(s[begun : m.start()])
            begun = m.end()
    return [*out, s[begun:]]


def _arguments(s: str) -> list[str]:
    """The braced arguments of a command."""
    closed = _closed(s, _SINGLE)
    out, at = [], 0
    while (at := s.find("{", at)) >= 0:
        end = closed.get(at)
        if end is None:
            at += 1
            continue
        out.append(s[at + 1 : end - 1])
        at = end
    return out


class _Writer:
    """Writes leaves of markup as clean text; remembers in which lists it is and whether a fence is open."""

    def __init__(self, field: "Field"):
        self.field = field
        self.lists: list[list] = []  # mark of the items, items so far

    def _again(self, s: str) -> str:
        return clean(s, self.field) if _LEAF.search(s) else s

    def _item(self) -> str:
        if not self.lists or self.lists[-1][0] == "- ":
            return "- "
        self.lists[-1][1] += 1
        return f"{self.lists[-1][1]}. "

    def _list(self, name: str, close: bool) -> None:
        if not close:
            self.lists.append([_LISTS[name], 0])
        elif self.lists:
            self.lists.pop()

    def tag(self, s: str) -> str:
        name = re.sub(r"[^a-z0-9]", "", s.lower().split()[0].strip("</>"))
        close = s.startswith("</")
        if name in ("ul", "ol"):
            self._list(name, close)
        if name == "li":
            return "" if close else "\n" + self._item()
        if name in ("td", "th"):
            return "\t" if close else ""
        if name == "pre":
            return "\n```\n"
        if m := re.fullmatch(r"h([1-6])", name):
            return "\n" + ("" if close else "#" * int(m[1]) + " ")
        return "\n" if name in _BLOCKS else ""

    def command(self, s: str) -> str:
        m = re.match(r"~?\{?\\([A-Za-z]+)", s)
        name = m[1] if m else ""
        args = _arguments(s) if not s.startswith("{") else []
        if name == "item":
            return self._item() + (f"{s[s.find('[') + 1 : s.find(']')]} " if "[" in s else "")
        if name in _LEVELS:
            return "#" * _LEVELS[name] + " " + self._again(args[0] if args else "")
        if name == "footnote":
            return f" ({self._again(args[0])})" if args else ""
        if name in _SILENT:
            return ""
        if name == "href" and len(args) > 1:
            return self._again(args[1])
        if name in _SHOWN:
            return self._again(args[0]) if args else ""
        return " ".join(a.strip("\\") for a in args) if name == "SI" else s

    def template(self, s: str) -> str:
        """The values of a template's parameters, named ones included; its own name names no content."""
        values = [p.split("=", 1)[-1].strip() if re.match(r"\s*[\w -]+=", p) else p.strip() for p in _split_top(s[2:-2])[1:]]
        return " ".join(self._again(v) for v in values if v)

    def wikilink(self, s: str) -> str:
        if not s.startswith("[["):
            return s.strip("[]").split(" ", 1)[-1]
        parts = _split_top(s[2:-2])
        if re.match(r"(?:Category|File|Image):", parts[0]) and len(parts) == 1:
            return ""
        return self._again(parts[-1])

    def write(self, kind: str, s: str) -> str:
        match kind:
            case "entity":
                return html.unescape(s).replace("\xa0", " ")
            case "tag":
                return self.tag(s)
            case "command":
                return self.command(s)
            case "template":
                return self.template(s)
            case "wikilink":
                return self.wikilink(s)
            case "fence":
                return "```"
            case "image":
                return re.sub(r"!\[([^\]]*)\].*", r"\1", s, flags=re.DOTALL)
            case "link":
                return re.sub(r"^\[([^\]]*)\].*", r"\1", s, flags=re.DOTALL).strip("<>")
            case "strong" | "under" | "strike" | "raised" | "code":
                return s.strip("*_~^`")
            case "hash":
                return s.strip() + " "
            case "wikihead":
                t = s.strip()
                level = len(t) - len(t.lstrip("="))
                return "#" * level + " " + t.strip("= \t")
            case "bullet":
                return s[: len(s) - len(s.lstrip())] + "- "
            case "row":
                return "" if re.fullmatch(r"[\s|:-]+", s) else "\t".join(self._again(c.strip()) for c in s.strip().strip("|").split("|"))
            case "wikitable":
                t = s.strip()
                return "" if t.startswith(("{|", "|}", "|-")) else "\t".join(self._again(c.strip()) for c in re.split(r"\|\||!!", t.strip("|!+ ")))
            case "display":
                return "\n" + s + "\n"
            case "environment":
                name = s[s.find("{") + 1 : s.find("}")].rstrip("*")
                if name in _LISTS:
                    self._list(name, s.startswith("\\end"))
                if name in ("verbatim", "lstlisting", "minted"):
                    return "```"
                return s if name in ("equation", "align", "gather", "multline", "eqnarray", "array", "matrix", "cases") else "\n"
            case "escape":
                return " " if s in ("\\,", "\\;", "\\:", "\\!") else s[1:]
            case "comment" | "switch" | "refline" | "setext" | "quotes" | "quote" | "wikiindent" | "other" | "footnote":
                return ""
        return s  # formulas, and signs that the field took for markup though they carry content


def clean(text: str | None, field: Field) -> str | None:
    """``text`` without markup; headings stand on lines of their own behind as many "#" as their level, list items behind
    "- " or their number, table cells between tabs, code blocks between fences; formulas stay as they are, and so does the
    text of footnotes, captions and parameters of templates. Null stays null."""
    if not text:
        return text
    found = leaves(text)
    ys = field.decode(features(text, found))
    if not any(ys):
        return text
    writer = _Writer(field)
    out: list[str] = []
    for (k, a, b), y in zip(found, ys):
        s = text[a:b]
        if y and k == "setext" and s.strip()[0] in "=-":  # the line above is a heading
            for i in range(len(out) - 1, -1, -1):
                if (line := out[i].rstrip("\n")) and line.strip():
                    cut = line.rfind("\n") + 1
                    out[i] = line[:cut] + ("# " if s.strip()[0] == "=" else "## ") + line[cut:] + out[i][len(line) :]
                    break
        out.append(s if y == 0 else writer.write(k, s))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", "".join(out))).strip()


# ---------------------------------------------------------------- tables


@functools.lru_cache(2)
def _unpickled(data: bytes) -> Field:
    return Field(*pickle.loads(data))


def _packed(field: Field) -> bytes:
    return pickle.dumps((field.index, field.weights, field.moves))


def texts(outputs: DataFrame, segments: DataFrame) -> DataFrame:
    """(field, rec_id, item_no, text, at) of all answers and segments; ``at`` is when an answer was made."""
    at = F.try_to_timestamp(F.regexp_replace("created_at", "Z$", "+00:00"))
    o = outputs.where("variant_id IS NOT NULL").select(F.lit("output").alias("field"), F.col("variant_id").alias("rec_id"), at.alias("at"), F.posexplode("step_outputs").alias("n", "text"))
    s = segments.where("doc_id IS NOT NULL AND seg_order IS NOT NULL").select(F.lit("segment").alias("field"), F.col("doc_id").alias("rec_id"), F.col("seg_order").cast("int").alias("item_no"), "text", F.lit(None).cast("timestamp").alias("at"))
    return o.select("field", "rec_id", (F.col("n") + 1).alias("item_no"), "text", "at").unionByName(s)


def _latest(outputs: DataFrame) -> DataFrame:
    at = F.try_to_timestamp(F.regexp_replace("created_at", "Z$", "+00:00"))
    return outputs.where("variant_id IS NOT NULL").groupBy(F.col("variant_id").alias("rec_id")).agg(F.max(at).alias("last"))


def suspect(c: Column) -> Column:
    return c.rlike(SUSPECT)


def residue(outputs: DataFrame, segments: DataFrame, field: Field | None = None) -> DataFrame:
    """(field, rec_id, item_no, markup) of every text and notation of which it holds residue.

    Texts without any sign of markup are left out by a regular expression in the scan; only labels
    are shuffled. Of several output rows of a variant the latest counts; null and blank texts have no
    rows, a segment delivered twice has its rows once.
    """
    spark = outputs.sparkSession
    shared = spark.sparkContext.broadcast(_packed(field or trained()))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = _unpickled(shared.value)
        for s in batches:
            yield pd.Series([notations(t, f) for t in s], dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    found = texts(outputs, segments).where(suspect(F.col("text"))).select("field", "rec_id", "item_no", "at", F.pandas_udf(run, T.ArrayType(T.StringType()))("text").alias("ks"))
    rows = found.select("field", "rec_id", "item_no", "at", F.explode("ks").alias("markup"))
    seg = rows.where("field = 'segment'").select("field", "rec_id", "item_no", "markup").distinct()
    out = rows.where("field = 'output'").join(_latest(outputs), "rec_id").where(F.col("at").eqNullSafe(F.col("last")))
    return seg.unionByName(out.select("field", "rec_id", "item_no", "markup").distinct())


def cleaned(outputs: DataFrame, segments: DataFrame, field: Field | None = None) -> DataFrame:
    """(field, rec_id, item_no, text): all texts that held residue, without it."""
    shared = outputs.sparkSession.sparkContext.broadcast(_packed(field or trained()))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = _unpickled(shared.value)
        for s in batches:
            yield pd.Series([clean(t, f) for t in s], dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    t = texts(outputs, segments).where(suspect(F.col("text"))).join(_latest(outputs), "rec_id", "left").where("field = 'segment' OR at <=> last")
    c = t.select("field", "rec_id", "item_no", "text", F.pandas_udf(run, T.StringType())("text").alias("clean"))
    return c.where("clean <> text").groupBy("field", "rec_id", "item_no").agg(F.min("clean").alias("text"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue(table(spark, sf_dir, "outputs_openai"), table(spark, sf_dir, "segments"))


def p6_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned(table(spark, sf_dir, "outputs_openai"), table(spark, sf_dir, "segments"))


SQL: dict[str, str] = {}
QUERIES = {"p6_found": p6_found, "p6_clean": p6_clean}
