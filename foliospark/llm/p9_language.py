"""Languages of documents and of their parts, and labels that are missing or wrong."""

from __future__ import annotations

import functools
import hashlib
import pickle
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import langmodel
from foliospark.llm.p4_sentences import sentence_ends
from foliospark.sources.tables import table

#: Labelled documents that the centroids of a language are fitted on, at most.
SAMPLE = 150
#: Spellings of labels that the sample draws on, the most frequent ones.
SAMPLE_LABELS = 2000
#: Seed of that sample.
SEED = 20260109
#: Letters and confidence that a stretch needs for a language of its own; whole sentences in a row that make a text mixed.
LEAST_LETTERS, LEAST_SURE, LEAST_SENTENCES = 12, 0.06, 2

_THAI = re.compile("[\u0e00-\u0e7f]")
_TURN = re.compile(r"(?<=[฀-๿])\s+(?=[A-Z][a-z]+ [a-z]+)|(?<=[a-z.]) (?=[฀-๿]{4})")  # between Thai and Latin sentences


def sample(documents: DataFrame, per_language: int = SAMPLE, seed: int = SEED) -> list[tuple[str, str]]:
    """(language, text) of at most about ``per_language`` random documents per label that names a language.

    The only rows that reach the driver; every label is thinned to the wanted number by a hash of the
    id, and texts beyond 2,000 characters lend a random stretch of that length.
    """
    counts = {r["lang"]: r["count"] for r in documents.where("lang IS NOT NULL").groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(SAMPLE_LABELS).collect() if langmodel.label_of(r["lang"]) in langmodel.LANGUAGES}
    if not counts:
        return []
    per_code = Counter()
    for k, n in counts.items():
        per_code[langmodel.label_of(k)] += n
    share = F.create_map(*[x for k in counts for x in (F.lit(k), F.lit(min(1.0, per_language / per_code[langmodel.label_of(k)])))])
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id")), 11) / F.lit(float(1 << 53))
    start = F.greatest(F.lit(1), (F.pmod(F.xxhash64("doc_id"), F.greatest(F.length("text") - 2000, F.lit(1))) + 1).cast("int"))
    rows = documents.where(F.col("lang").isin(*counts) & (u < share[F.col("lang")])).where("length(trim(text)) > 0").select("doc_id", "lang", F.substr("text", start, F.lit(2000)).alias("text"))
    got = rows.limit(4 * per_language * len(langmodel.LANGUAGES)).collect()
    return [(langmodel.label_of(r["lang"]), r["text"]) for r in sorted(got, key=lambda r: r["doc_id"])]


_FITTED: dict[tuple, langmodel.Model] = {}


def fitted(documents: DataFrame) -> langmodel.Model:
    """The model of a sample of ``documents``; fitted once for a session and a set of files."""
    files = documents.inputFiles()
    key = (documents.sparkSession.sparkContext.applicationId, hashlib.blake2b("\n".join(sorted(files)).encode()).digest())
    if not files or key not in _FITTED:
        model = langmodel.fit(sample(documents), SAMPLE)
        if not files:
            return model
        _FITTED.clear()
        _FITTED[key] = model
    return _FITTED[key]


class Languages:
    """Splits texts into parts of one language each."""

    def __init__(self, model: langmodel.Model):
        self.of = model.classifier()

    def _bounds(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of the sentences, cut where Thai and Latin ones meet."""
        bounds = []
        begun = 0
        if not _THAI.search(text):
            for e in sentence_ends(text):
                bounds.append((begun, e))
                begun = e
            return bounds
        for e in sentence_ends(text):
            cuts = [m.start() + begun for m in _TURN.finditer(text[begun:e])]
            for c in [*cuts, e]:
                bounds.append((begun, c))
                begun = c
        return bounds

    def _parts(self, bounds: list[tuple[int, int]], lang: np.ndarray, conf: np.ndarray, letters: np.ndarray, near: np.ndarray) -> list[tuple]:
        """(start, end, sentences, language, letters, margin, nearness) of the stretches of one language, by whole sentences."""
        out: list[list] = []
        for (a, b), k, c, n, d in zip(bounds, lang.tolist(), conf.tolist(), letters.tolist(), near.tolist()):
            if n < LEAST_LETTERS or k < 0 or c < LEAST_SURE:
                k = None
            if out and (k is None or out[-1][3] is None or out[-1][3] == k):
                p = out[-1]
                p[1] = b
                p[2] += n >= LEAST_LETTERS
                p[5] = (p[5] * p[4] + c * n) / max(p[4] + n, 1)
                p[6] = (p[6] * p[4] + d * n) / max(p[4] + n, 1)
                p[4] += n
                p[3] = p[3] if p[3] is not None else k
            else:
                out.append([a, b, int(n >= LEAST_LETTERS), k, n, c, d])
        return [tuple(p) for p in out if p[3] is not None]

    def of_batch(self, texts: list[str]) -> list[list[tuple]]:
        """The parts of every text: one for a text of one language. Every text is cut into whole sentences."""
        bounds = [self._bounds(t) for t in texts]
        lang, conf, letters, near = self.of.per_text([t[a:b] for t, bs in zip(texts, bounds) for a, b in bs])
        out = []
        at = 0
        for t, bs in zip(texts, bounds):
            ks, ns, cs, ds = (x[at : at + len(bs)] for x in (lang, letters, conf, near))
            at += len(bs)
            known = ks >= 0
            total = float(ns[known].sum())
            if not total or 2 * total < float(ns.sum()):  # most of it is near to none of the languages
                out.append([])
                continue
            parts = self._parts(bs, ks, cs, ns, ds)
            if len({p[3] for p in parts}) > 1:
                out.append(parts)
            else:  # a text without any sure sentence is of the language of most letters
                main = parts[0][3] if parts else int(np.argmax(np.bincount(ks[known], ns[known], len(langmodel.LANGUAGES))))
                mine = known & (ks == main)
                out.append([(0, len(t), len(bs), main, total, float((cs[mine] * ns[mine]).sum() / total), float((ds[mine] * ns[mine]).sum() / ns[mine].sum()))])
        return out


def summary(parts: list[tuple]) -> tuple[str | None, float, float, list[str]]:
    """(main language, margin, nearness, languages of a mixed text) of a text's parts."""
    by, sure, near = Counter(), Counter(), Counter()
    for _, _, _, k, n, c, d in parts:
        by[k] += n
        sure[k] += c * n
        near[k] += d * n
    if not by:
        return None, 0.0, 0.0, []
    main = max(by, key=lambda k: (by[k], -k))
    others = sorted({p[3] for p in parts if p[3] != main and p[2] >= LEAST_SENTENCES})
    name = langmodel.LANGUAGES
    return name[main], sure[main] / sum(by.values()), near[main] / max(by[main], 1), [name[main], *[name[k] for k in others]] if others else []


@functools.lru_cache(2)
def _languages(model: bytes) -> Languages:
    return Languages(pickle.loads(model))


def _with_model(documents: DataFrame, columns: list[str], rows_of, schema: str, names: list[str], types: list, model: langmodel.Model | None) -> DataFrame:
    model = model or fitted(documents)
    shared = documents.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages = _languages(shared.value)
        for b in batches:
            for f in range(0, b.num_rows, 2000):
                x = b.slice(f, 2000)
                rows = rows_of(languages, *[c.to_pylist() for c in x.columns])
                cols = list(zip(*rows)) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types)], names=names)

    return documents.select(*columns).mapInArrow(run, schema)


def _problems(languages: Languages, ids, texts, labels):
    keep = [i for i, t in enumerate(texts) if t]
    for i, parts in zip(keep, languages.of_batch([texts[i] for i in keep])):
        main, sure, near, mixed = summary(parts)
        if main is None:
            continue
        label = langmodel.label_of(labels[i])
        sure = languages.of.confidence(sure)
        if label is None:
            yield ids[i], "missing", main, sure
        elif label != main and (label in langmodel.LANGUAGES or languages.of.beyond_doubt(main, near)):
            yield ids[i], "wrong", main, sure
        for k in mixed:
            yield ids[i], "mixed", k, sure


def label_problems(documents: DataFrame, model: langmodel.Model | None = None) -> DataFrame:
    """(doc_id, problem, lang, confidence) of labels that are missing or wrong, and of mixed texts.

    Null, empty and wordless texts, and texts of which most is near to none of the languages, give no row. A
    label that names a language that isn't known here is wrong only where the text is as near to a known one as its own texts are.
    The corpus isn't shuffled; the model, of a fixed size, is broadcast.
    """
    kinds = [pa.int64(), pa.string(), pa.string(), pa.float64()]
    docs = documents.withColumn("doc_id", F.col("doc_id").cast("long"))
    return _with_model(docs, ["doc_id", "text", "lang"], _problems, "doc_id bigint, problem string, lang string, confidence double", ["doc_id", "problem", "lang", "confidence"], kinds, model)


def _segments(languages: Languages, ids, texts):
    for i, t in zip(ids, texts):
        for n, (a, b, _, k, _, c, _) in enumerate(languages.of_batch([t])[0] if t else [], 1):
            yield i, n, a, b, langmodel.LANGUAGES[k], languages.of.confidence(c)


def language_parts(documents: DataFrame, model: langmodel.Model | None = None) -> DataFrame:
    """(doc_id, part_no, start_pos, end_pos, lang, confidence): the language of every document, part by part.

    Confidence is the share of right answers among labelled sentences of such a margin. Null, empty and
    wordless texts, and those of which most is near to none of the languages, give no row.
    """
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64()]
    names = ["doc_id", "part_no", "start_pos", "end_pos", "lang", "confidence"]
    docs = documents.withColumn("doc_id", F.col("doc_id").cast("long"))
    # The sample needs labels; they aren't sent to the workers.
    return _with_model(docs, ["doc_id", "text"], _segments, "doc_id bigint, part_no int, start_pos int, end_pos int, lang string, confidence double", names, kinds, model)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_problems(table(spark, sf_dir, "documents")).select("doc_id", "problem", "lang")


def p9_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_parts(table(spark, sf_dir, "documents"))


SQL: dict[str, str] = {}
QUERIES = {"p9_found": p9_found, "p9_parts": p9_parts}
