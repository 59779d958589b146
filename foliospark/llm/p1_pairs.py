"""Defects of prompt and answer pairs.

Sentences at the opening of answers are clustered by MinHash, with every link verified; clusters that
recur across unrelated prompts are templates, which reveal refusals. Checks of copying, language and
termination label the other defects.
"""

from __future__ import annotations

import functools
import hashlib
import pickle
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm import langmodel, textform
from foliospark.llm.p4_sentences import split_sentences
from foliospark.llm.p9_language import fitted
from foliospark.operators.components import components
from foliospark.session import cut_lineage
from foliospark.sources.tables import table

#: Words of a shingle, similarity of a link, and hashes of a signature by bands.
SHINGLE, SIMILAR, BANDS, ROWS = 5, 0.8, 8, 4
#: Sentences that make up an opening; seeds over which a cluster must recur to be a template.
OPENING_SENTENCES, RECUR_SEEDS = 3, 2
#: Words besides templates from which on an answer carries content.
CONTENT_WORDS = 20
#: Share of a template's words that stand in the prompts, from which on it belongs to what was asked.
RELATED = 0.5
#: Words whose hashes a worker remembers; beyond that it forgets all. Changes speed only.
MEMO = 400_000
#: Similarity in words from which on an answer is a copy; paragraphs that are wanted.
COPY, PARAGRAPHS = 0.93, 3

# Wordings by which an answer declines, per language.
_NEGATION = r"(?:not|n't|cannot|unable|decline|declining|refuse|pass on|against|rather not|no longer)"
DECLINES = [
    rf"\bi(?:'m|'d|'ll|'ve)?\b.{{0,80}}?\b\w*{_NEGATION}\b", rf"\b(?:request|task|assistant|model language|language model)\b.{{0,60}}{_NEGATION}\b", r"\bas an ai\b",
    rf"\b(?:sorry|apolog\w+|unfortunately|regrettably|regret)\b.{{0,120}}(?:{_NEGATION}\b|may not|decline)", r"\b(?:must|have to) (?:decline|refuse)\b",
    r"죄송|유감|미안|(?:드릴|할|수행할|제공할|도와드릴) 수 없|어렵습니다|불가능합니다|거절|지침에 어긋", r"抱歉|对不起|無法|无法(?:完成|提供|协助|帮助|满足)|不能(?:协助|提供|帮助)|拒绝", r"申し訳|すみません|できません|いたしかねます|お断り|お手伝いでき",
    r"\b(?:leider|tut mir leid|bedau(?:ere|erlicherweise))\b|\bkann ich (?:nicht|das nicht)\b", r"\b(?:désolée?|regrette|malheureusement)\b|\bje ne (?:peux|suis|saurais)\b", r"\b(?:lo siento|lamento|lamentablemente)\b|\bno puedo\b",
    r"\b(?:mi dispiace|purtroppo|spiacente)\b|\bnon posso\b", r"\b(?:desculpe|lamento|infelizmente|sinto muito)\b|\bnão posso\b", r"\b(?:het spijt me|helaas|sorry)\b.{0,80}\bniet\b|\bik kan\b.{0,40}\bniet\b", r"извините|к сожалению|не могу|прошу прощения", r"ขออภัย|ขอโทษ|ไม่สามารถ", r"क्षमा|खेद|असमर्थ|नहीं कर सकता",
]
_DECLINE = re.compile("|".join(f"(?:{d})" for d in DECLINES))
# Remarks around an answer.
_OPENER = re.compile(r"^\s*(?:(?:sure|certainly|of course|absolutely|okay|ok|yes|here|below|thank you|thanks|gladly|happy to|great|understood|물론|네|다음은|아래는|여기|감사)\b[^\n]{0,110}?[.:!,]|[^\n.!?]{0,90}:)\s*(?=\n|$)", re.IGNORECASE)
_OPENER_LINE = re.compile(r"^\s*(?:sure|certainly|of course|absolutely|here (?:is|are|you)|below (?:is|are)|thank you for (?:sharing|the)|물론입니다|네,|다음은|아래는)[^\n]{0,110}?[.:!]\s+", re.IGNORECASE)
_CLOSER = re.compile(r"(?:^|\n)\s*(?:i hope (?:this|that|it)\b|let me know\b|please let me know\b|feel free\b|if you (?:need|would|want|like)\b|hope this helps|do you want\b|would you like\b|도움이 되|추가로)[^\n]{0,160}\s*$", re.IGNORECASE)
_NAMES = "|".join(sorted({n for v in langmodel.NAMES.values() for n in v.split() if len(n) > 3}))
_INTO = re.compile(rf"\binto\s+({_NAMES})\b", re.IGNORECASE)
_IN = re.compile(rf"\b(?:in|to)\s+({_NAMES})\b", re.IGNORECASE)
_WORD = re.compile(r"[^\W_]+")
# Abbreviations that leave a sentence open.
_OPEN_END = re.compile(r"(?:^|[\s(])(?:e\.g|i\.e|vs|cf|al|Dr|Prof|Fig|Figs|Eq|Eqs|Ref|Refs|Sec|No|approx)\.$|(?<=[\s(.])(?<![\d²³⁻¹)%°] )[A-Z]\.$")
_END = re.compile(r"(?:[.!?…。！？।]|\.\.\.)[\"'”’»)\]」』*_~`}]*$")


def words(text: str) -> list[str]:
    return _WORD.findall(textform.fold(text).lower().replace("’", "'"))


def is_empty(answer: str | None) -> bool:
    """Whether an answer holds no letter or digit."""
    return not answer or not _WORD.search(textform.fold(answer))


def without_remarks(answer: str) -> str:
    """An answer without an opening and a closing remark."""
    t = answer.strip()
    for _ in range(2):
        m = _OPENER.match(t) or _OPENER_LINE.match(t)
        if m and len(t) - m.end() > m.end():
            t = t[m.end() :].lstrip()
    m = _CLOSER.search(t)
    return t[: m.start()].rstrip() if m and m.start() > len(t) // 3 else t


def asked_language(prompt: str) -> str:
    """The language that the first paragraph of a prompt asks for; English where it names none."""
    first = prompt.split("\n\n", 1)[0]
    m = (_INTO.findall(first) or _IN.findall(first))[-1:]
    return langmodel.label_of(m[0]) if m else "en"


def in_order(a: list[str], b: list[str]) -> int:
    """Words that two texts have in common in order (the longest common subsequence), in one pass over bits of ``a`` per word of ``b``."""
    n = min(len(a), len(b))
    head = next((i for i in range(n) if a[i] != b[i]), n)
    tail = next((i for i in range(n - head) if a[-1 - i] != b[-1 - i]), n - head)
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    at: dict[str, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    every = (1 << len(a)) - 1
    free = every  # zero bits: where the subsequence grows
    for w in b:
        if hit := at.get(w, 0) & free:
            free = (free + hit | free - hit) & every
    return head + tail + len(a) - free.bit_count()


def similarity(a: list[str], b: list[str]) -> float:
    """Words of two texts that match in order, as a share of all, 0 to 1; 0 at once where the words alone are too different."""
    if not a or not b:
        return 0.0
    common = sum((Counter(a) & Counter(b)).values())
    if 2 * common / (len(a) + len(b)) < COPY:
        return 0.0
    return 2 * in_order(a, b) / (len(a) + len(b))


def is_copy(act: str | None, prompt: str, answer: str) -> bool:
    """Whether an answer is the prompt, or what follows its first paragraph (a valid answer to proofreading)."""
    told, _, rest = prompt.partition("\n\n")
    told, all_of_it = words(told), words(prompt)
    for t in dict.fromkeys((answer, without_remarks(answer))):
        w = words(t)
        if act == "proofreading":
            if similarity(w, all_of_it) >= COPY and 2 * similarity(w[: len(told)], told) > COPY:
                return True
        elif similarity(w, all_of_it) >= COPY or similarity(w, words(rest)) >= COPY:
            return True
    return False


_FENCE = re.compile(r"```.*?(?:```|$)", re.DOTALL)
_BLOCK_MATH = re.compile(r"\$\$.*?\$\$|\\\[.*?\\\]|\\begin\{(equation|align|table|tabular|figure)\*?\}.*?\\end\{\1\*?\}", re.DOTALL)
_TABLE = re.compile(r"\{\|.*?\|\}|<table.*?</table>|<pre.*?</pre>|<!--.*?-->|<figure.*?</figure>", re.DOTALL | re.IGNORECASE)
_ROW = re.compile(r"^[ \t]*(?:\|.*\||[=-]{3,}|#{1,6}\s.*|={1,6}[^=].*={1,6}|\*\*[^*\n]{1,60}\*\*|!\[[^\]]*\]\([^)]*\)|\[\^?\w+\]:.*|\\(?:sub)*section\{.*\}|\\(?:begin|end)\{.*\}|<h\d.*</h\d>|<hr ?/?>|\[\[(?:Category|File|Image):.*\]\]|----+|\{\{[^}]*\}\})[ \t]*$", re.MULTILINE | re.IGNORECASE)
_UNDERLINED = re.compile(r"^[^\n]{1,60}\n[=-]{3,}\s*$", re.MULTILINE)
_TAG = re.compile(r"</?[a-zA-Z][^<>\n]{0,200}>|&[a-z]+;|&#\d+;")
_MARK = re.compile(r"^[ \t]*(?:[>*#:;-]+[ \t]+|\d{1,2}[.)][ \t]+|\\item[ \t]*)", re.MULTILINE)


def prose(answer: str) -> list[str]:
    """The paragraphs of running text in an answer, without blocks of code, tables, formulas and headings."""
    t = _FENCE.sub("\n\n", answer)
    t = _TABLE.sub("\n\n", t)
    t = _BLOCK_MATH.sub(" ", t)
    t = re.sub(r"</(?:p|div|li|h\d)>\s*<", "\n\n<", t)
    t = _UNDERLINED.sub("\n", t)
    t = _ROW.sub("", t)
    t = _TAG.sub(" ", t)
    t = _MARK.sub("", t)
    return [p for x in re.split(r"\n\s*\n", t) if _WORD.search(p := x.strip())]


def is_truncated(answer: str) -> bool:
    """Whether an answer stops within a sentence or has fewer paragraphs than wanted."""
    ps = prose(without_remarks(answer))
    if len(ps) < PARAGRAPHS:
        return True
    last = textform.fold(ps[-1]).rstrip()
    last = re.sub(r"(?:\s*(?:\\[)\]a-zA-Z]+\{?[^}\s]*\}?|\[\^?\w+\]|\{\{[^}]*\}\}|'{2,}|\}))+$", "", last).rstrip()
    return not _END.search(last) or bool(_OPEN_END.search(last))


@functools.lru_cache(2)
def _classifier(model: bytes) -> langmodel.Classifier:
    return pickle.loads(model).classifier()


def wrong_language(answers: list[str], asked: list[str], classifier: langmodel.Classifier) -> list[bool]:
    """For every answer whether next to nothing of it is in the language asked for."""
    parts, owner = [], []
    for i, a in enumerate(answers):
        for p in re.split(r"\n+|(?<=[.!?]) +(?=[A-ZÀ-Þ])", without_remarks(a)):
            if _WORD.search(p):
                parts.append(p)
                owner.append(i)
    lang, sure, letters, _ = classifier.per_text(parts)
    total, right = np.zeros(len(answers)), np.zeros(len(answers))
    for i, k, n in zip(owner, lang.tolist(), letters.tolist()):
        if k >= 0:
            total[i] += n
            right[i] += n * (langmodel.LANGUAGES[k] == asked[i])
    return [bool(t >= 40 and r < 0.2 * t) for t, r in zip(total, right)]


def pairs(tasks: DataFrame, outputs: DataFrame) -> DataFrame:
    """(variant_id, seed_id, act, step_no, prompt, answer) of every step of a task that has an output row.

    Of several output rows of a variant the one with the latest ``created_at`` counts; of tasks
    delivered twice one. ``{PREVIOUS_OUTPUT}`` in a prompt is replaced by the answer before it, or
    removed where there is none. A missing or short list of answers gives null answers.
    """
    t = tasks.where("variant_id IS NOT NULL AND steps IS NOT NULL").groupBy("variant_id").agg(F.min(F.struct("seed_id", "act", "steps")).alias("t"))
    at = F.try_to_timestamp(F.regexp_replace("created_at", "Z$", "+00:00"))
    o = outputs.where("variant_id IS NOT NULL").groupBy("variant_id").agg(F.max(F.struct(at.alias("at"), F.col("created_at"), F.col("step_outputs"))).alias("o"))
    j = t.join(o, "variant_id").select("variant_id", "t.seed_id", "t.act", F.posexplode("t.steps").alias("n", "step"), F.col("o.step_outputs").alias("answers"))
    before = F.when(F.col("n") > 0, F.get("answers", F.col("n") - 1))
    prompt = F.replace(F.coalesce("step", F.lit("")), F.lit("{PREVIOUS_OUTPUT}"), F.coalesce(before, F.lit("")))
    return j.select("variant_id", "seed_id", "act", (F.col("n") + 1).alias("step_no"), prompt.alias("prompt"), F.get("answers", F.col("n")).alias("answer"))


_CHECKED = "variant_id string, seed_id string, step_no int, defect string, content int, own boolean, units array<struct<i:int,text:string,words:int,declines:boolean,polite:boolean,related:double>>"


def _checker(model):
    """Checks of single pairs; the classifier's model is broadcast."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classifier = _classifier(model.value)
        for b in batches:
            answers = [a or "" for a in b["answer"]]
            wrong = wrong_language(answers, [asked_language(p) for p in b["prompt"]], classifier)
            rows = []
            for v, s, act, n, prompt, a, w in zip(b["variant_id"], b["seed_id"], b["act"], b["step_no"], b["prompt"], answers, wrong):
                if is_empty(a):
                    rows.append((v, s, n, "empty", 0, False, []))
                    continue
                defect = "copied" if is_copy(act, prompt, a) else "wrong_language" if w else "truncated" if is_truncated(a) else None
                # A refusal outranks these.
                said = [(" ".join(x), len(x), y) for y in split_sentences(a) if (x := words(y))]
                asked = set(words(prompt))
                units = []
                for i, (text, k, y) in enumerate(said):
                    first = i < OPENING_SENTENCES
                    declines = first and bool(_DECLINE.search(textform.fold(y).lower().replace("’", "'")))
                    polite = first and bool(_OPENER.match(y) or _OPENER_LINE.match(y + " "))
                    units.append((i, text, k, declines, polite, sum(x in asked for x in text.split()) / k))
                own = any(u[3] for u in units)
                if not own and defect not in ("wrong_language", "truncated"):
                    units = units[:OPENING_SENTENCES]
                rows.append((v, s, n, defect, sum(k for _, k, _ in said), own, units))
            yield pd.DataFrame(rows, columns=["variant_id", "seed_id", "step_no", "defect", "content", "own", "units"])

    return check


def shingles(text: str) -> set[str]:
    w = text.split()
    return {" ".join(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)} or {text}


@functools.cache
def _salts() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(11)
    odd = lambda n: r.integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1)
    return odd(BANDS * ROWS), odd(SHINGLE)


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > MEMO:
            self.clear()
        self[word] = h = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return h


_HASHES = _WordHashes()


def signatures(texts: list[str]) -> list[list[int]]:
    """One key per band of the MinHash signature of every text's shingles; none for texts of one shingle, which are like no other."""
    salts, powers = _salts()
    ws = [t.split() for t in texts]
    long = [i for i, w in enumerate(ws) if len(w) > SHINGLE]
    out: list[list[int]] = [[] for _ in texts]
    if not long:
        return out
    hashes = np.fromiter((_HASHES[w] for i in long for w in ws[i]), np.uint64)
    sizes = np.array([len(ws[i]) for i in long])
    n = len(hashes) - SHINGLE + 1
    rolled = np.zeros(n, np.uint64)
    for j in range(SHINGLE):
        rolled += hashes[j : j + n] * powers[j]
    rolled ^= rolled >> np.uint64(29)
    begins = np.cumsum(sizes) - sizes
    inside = np.ones(len(hashes), bool)  # shingles that don't reach into the next text
    for j in range(1, SHINGLE):
        inside[begins + sizes - j] = False
    rolled = rolled[inside[:n]]
    counts = sizes - SHINGLE + 1
    at = np.cumsum(counts) - counts
    keys = np.zeros((len(long), BANDS), np.uint64)
    for k in range(BANDS * ROWS):
        low = np.minimum.reduceat((rolled * salts[k]) >> np.uint64(24), at)
        keys[:, k // ROWS] = (keys[:, k // ROWS] ^ low) * salts[-1 - k // ROWS] + np.uint64(k // ROWS)
    for i, row in zip(long, keys.view(np.int64).tolist()):
        out[i] = row
    return out


@F.pandas_udf(T.ArrayType(T.LongType()))
def _bands(s: pd.Series) -> pd.Series:
    return pd.Series(signatures(s.tolist()), dtype=object)


def _shingled(c: str) -> Column:
    return F.expr(f"array_distinct(transform(sequence(0, greatest(size(split({c}, ' ')) - {SHINGLE}, 0)), i -> array_join(slice(split({c}, ' '), i + 1, {SHINGLE}), ' ')))")


def _alike(a: str, b: str) -> Column:
    return F.size(F.array_intersect(_shingled(a), _shingled(b))) >= F.round(F.lit(SIMILAR) * F.size(F.array_union(_shingled(a), _shingled(b))), 9)


def clusters(texts: DataFrame) -> DataFrame:
    """(text, cluster): the connected classes of distinct texts that share 0.8 of their five-word shingles, named by their smallest text.

    Candidates share a band of their MinHash signatures; every link is verified. In a band every text is
    verified against the band's smallest text, so links grow with the texts, not with their pairs. The
    texts of a band that aren't like its smallest one are verified with all those of the band with which
    they share one of the shingles by which such a pair must meet (the smallest fifth of each text's
    shingles in one order, an exact condition). A text without a link is a class of its own. Null texts
    are left out, repeated ones count once, an empty table gives no rows.
    """
    one = cut_lineage(texts.where("text IS NOT NULL").select("text").distinct().withColumn("id", F.unhex(F.md5("text"))))
    banded = one.select("id", F.explode(_bands("text")).alias("band"))
    ends = banded.groupBy("band").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least <> most").select("band", "least")
    crowded = cut_lineage(banded.join(ends, "band"))
    named = lambda x: one.select(F.col("id").alias(x), F.col("text").alias(f"text_{x}"))

    def verified(pairs: DataFrame) -> DataFrame:
        return cut_lineage(pairs.distinct().join(named("a"), "a").join(named("b"), "b").where(_alike("text_a", "text_b")).select("a", "b"))

    links = verified(crowded.where("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b")))
    known = links.select(F.col("a").alias("least"), F.col("b").alias("id"), F.lit(True).alias("like"))
    state = crowded.join(known, ["least", "id"], "left").withColumn("apart", F.col("like").isNull() & (F.col("id") != F.col("least")))
    mixed = state.where("apart").select("band").distinct()
    # Two texts of at least 0.8 share one of the first n - ceil(0.8 n) + 1 of their n shingles in any order.
    hashed = F.array_sort(F.transform(_shingled("text"), lambda x: F.xxhash64(x)))
    first = F.expr(f"slice(h, 1, size(h) - cast(ceil(round({SIMILAR} * size(h), 9)) as int) + 1)")
    keyed = cut_lineage(state.join(mixed, "band").join(one, "id").select("band", "id", "apart", hashed.alias("h")).select("band", "id", "apart", F.explode(first).alias("h")))
    other = keyed.select("band", "h", F.col("id").alias("other"), F.col("apart").alias("other_apart"))
    across = keyed.where("apart").join(other, ["band", "h"]).where("id < other OR (id > other AND NOT other_apart)").select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))
    comp = components(links.unionByName(verified(across)))
    linked = one.join(comp, F.col("id") == F.col("node"))
    named = linked.groupBy("component").agg(F.min("text").alias("cluster"))
    return one.join(comp, F.col("id") == F.col("node"), "left").join(named, "component", "left").select("text", F.coalesce("cluster", "text").alias("cluster"))


def refusals(checked: DataFrame) -> DataFrame:
    """(variant_id, step_no) of the answers that open with a template of refusals and hold next to nothing besides templates.

    Opening sentences of all answers, and all sentences of answers that may be refusals, are clustered; a
    cluster that recurs in answers to prompts of several seeds is a template. It is one of refusals if
    most answers that open with it hold nothing besides templates, and it isn't a polite opener nor made
    of the words of the prompts; wordings known to decline only break ties, for a template that few
    answers open with, and for an answer that declines in a wording of its own behind a template.
    """
    key = ["variant_id", "step_no"]
    units = cut_lineage(checked.select(*key, "seed_id", "content", "own", F.explode("units").alias("u")).select(*key, "seed_id", "content", "own", "u.*"))
    one = units.groupBy("text").agg(F.min("seed_id").alias("lo"), F.max("seed_id").alias("hi"), F.max("declines").alias("declines"), F.max("polite").alias("polite"))
    labelled = clusters(units.select("text")).join(one, "text")
    often = labelled.groupBy("cluster").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("declines").alias("c_declines"), F.max("polite").alias("c_polite")).where("lo <> hi").select("cluster", "c_declines", "c_polite")
    known = cut_lineage(labelled.select("text", "cluster").join(often, "cluster"))
    said = units.join(known, "text")
    opening = F.col("i") < OPENING_SENTENCES
    hit = said.groupBy(*key).agg(
        F.first("own").alias("own"), (F.first("content") - F.sum("words") < CONTENT_WORDS).alias("bare"),
        F.collect_set(F.when(opening, F.struct("cluster", "c_declines", "c_polite"))).alias("opens"), F.max(F.when(opening, F.col("related"))).alias("related"),
    )
    hit = cut_lineage(hit.where("size(opens) > 0"))
    opens = hit.select(*key, "bare", "related", F.explode("opens").alias("c")).select(*key, "bare", "related", "c.*")
    share = F.avg(F.when(F.col("bare"), 1).otherwise(0))
    use = opens.groupBy("cluster").agg(share.alias("share"), F.avg("related").alias("related"), F.first("c_declines").alias("c_declines"), F.first("c_polite").alias("c_polite"))
    refusing = use.where(f"c_declines OR (share > 0.5 AND NOT c_polite AND related < {RELATED})").select("cluster")
    bare = hit.where("bare")
    by_template = opens.where("bare").join(refusing, "cluster", "left_semi").select(*key)
    return bare.where("own").select(*key).union(by_template).distinct()


def defects(tasks: DataFrame, outputs: DataFrame, model: langmodel.Model | None = None) -> DataFrame:
    """(variant_id, step_no, defect) of the defective pairs; see the checks for what each defect is.

    The first that fits of empty, refusal, copied, wrong_language, truncated is given. The openings of all
    answers are clustered, and all sentences of those that may be refusals. ``model`` tells languages; by
    default it knows frequent words only.
    """
    shared = tasks.sparkSession.sparkContext.broadcast(pickle.dumps(model or langmodel.fit([])))  # a few MB
    checked = cut_lineage(pairs(tasks, outputs).mapInPandas(_checker(shared), _CHECKED))
    refused = refusals(checked).withColumn("refused", F.lit("refusal"))
    label: Column = F.when(F.col("defect") == "empty", F.col("defect")).otherwise(F.coalesce("refused", "defect"))
    return checked.join(refused, ["variant_id", "step_no"], "left").select("variant_id", "step_no", label.alias("defect")).where("defect IS NOT NULL")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defects(table(spark, sf_dir, "tasks"), table(spark, sf_dir, "outputs_openai"), fitted(table(spark, sf_dir, "documents")))


SQL: dict[str, str] = {}
QUERIES = {"p1_found": p1_found}
