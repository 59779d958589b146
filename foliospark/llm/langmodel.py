"""Language of texts by nearest centroids of TF-IDF character n-grams, with rejection by distance."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np

from foliospark.llm import textform

LANGUAGES = ("en", "de", "fr", "es", "it", "pt", "nl", "ru", "ko", "zh", "ja", "th", "hi")
#: Hashed n-gram features, longest n-gram, centroids per language.
FEATURES, LONGEST, CENTROIDS = 16384, 3, 3
#: Words that a worker remembers; beyond that it forgets all. Changes speed only.
MEMO = 200_000
#: Nearness below which a text belongs to none of the languages, for languages without labelled texts. For others it is
#: ``REJECT_SHARE`` of what all but ``REJECT_QUANTILE`` of the sentences of their labelled texts reach, as texts on other
#: matters are farther off. A label that names another language than these is only doubted where a text reaches ``DOUBT_SHARE``.
REJECT, REJECT_SHARE, DOUBT_SHARE, REJECT_QUANTILE = 0.025, 0.5, 0.9, 0.01
#: Sentences of labelled texts that a language needs for a limit of its own; letters from which on a sentence counts.
LEAST_FITTED, LEAST_FITTED_LETTERS = 20, 20

# Frequent words of each language, so that one without labelled texts is known too.
SEED_TEXTS = {
    "en": "the of and to in a is that for it with as was on are by this be at from or an have not which but were they we can has been their more will if also one when used between these than other such there would about into some only may after first most each using both under over during while because however thus where our results study measured shown",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei wenn können diese zwischen unter sehr ohne während dabei wir gemessen gezeigt ergebnisse",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la avec son ou été aux cette ont mais comme nous on ses leur entre deux être fait même aussi sans peut tout très depuis lorsque dont selon après avant chez cela ainsi donc mesuré résultats essais étude",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está nos porque durante según donde hay han mediante así cada otra estos resultados medido estudio",
    "it": "di e il la che in un a per è una sono con del non da i le al si della dei nel alla come più anche ma ha lo gli o delle dalla su se questo questa stato tra degli nella cui essere ci molto dopo senza fino quando loro perché ogni sulla dove secondo prima così può stati misurato risultati studio",
    "pt": "de a o que e do da em um para é com não uma os no se na por mais as dos como mas foi ao ele das tem à seu sua ou ser quando muito há nos já está eu também só pelo pela até isso ela entre era depois sem mesmo aos ter seus quem nas me esse eles estão você tinha foram essa num nem suas meu às minha numa resultados medido estudo",
    "nl": "de van het een en in is dat op te zijn met die voor niet aan er om ook als dan maar bij uit nog naar door over ze zich hij heeft of was worden wordt deze kan meer werd tot geen dit hun tussen onder zonder tijdens omdat waar wij na al zeer veel andere gemeten resultaten proeven onderzoek volgens",
    "ru": "и в не на я что он с как это по но они мы из у за от так же для вы все бы о его к или если её при уже только быть когда был до был были этот того между более также может после без под над через чтобы который которые где есть нет ещё очень можно результаты измерена работы значение",
    "ko": "이 그 저 것 수 등 및 에서 으로 하는 있다 있는 하였다 되었다 위해 대한 통해 따라 또한 그리고 그러나 때문에 경우 사용 연구 결과 실험 측정 증가 감소 나타났다 대하여 본 연구에서는 이러한 관한 의하여 보다 같은 매우 가능 없이 다른 모든 우리는 값은 하지만 따르면 조사하였다 적합하지 않다",
    "zh": "的 一 是 在 不 了 有 和 人 这 中 大 为 上 个 国 我 以 要 他 时 来 用 们 生 到 作 地 于 出 就 分 对 成 会 可 主 发 年 动 同 工 也 能 下 过 子 说 产 种 面 而 方 后 多 定 行 学 法 所 民 得 经 我们 实验 结果 研究 表明 测得 提高 下降 其中 因此 由于 然而 这一 数值",
    "ja": "の に は を た が で て と し れ さ ある いる も する から な こと として い や など なっ ない この ため その あっ よう また もの という あり まで られ なる へ か だ これ によって により おり より による ず なり られる において について われわれ 実験 測定 結果 得た 増加 低下 できる である",
    "th": "ที่ และ ใน การ เป็น ของ ได้ มี ให้ ว่า จะ ไม่ ความ กับ จาก โดย นี้ แต่ ซึ่ง หรือ เพื่อ อยู่ ต้อง มา แล้ว เรา ค่า ทำ พบว่า ดังนั้น เมื่อ เพราะ เนื่องจาก การทดลอง ผล วัด เพิ่มขึ้น ลดลง งานวิจัย ก่อนหน้านี้ รายงาน วัสดุ อุณหภูมิ สูง ต่ำ",
    "hi": "के का की में है और से को पर यह एक हैं नहीं कि भी ने था लिए जो तो इस वह कर हो कुछ थी तक या अपने साथ बाद किया गया जब होता हुए बहुत थे ही अगर मान प्रयोग परिणाम मापी अध्ययन क्योंकि जैसे निर्भर करती ऊपर बढ़कर मिलाने बिना संभव",
}
# Two-letter language codes, and names and three-letter codes of languages.
CODES = set(
    "aa ab ae af ak am an ar as av ay az ba be bg bh bi bm bn bo br bs ca ce ch co cr cs cu cv cy da de dv dz ee el en eo es et eu fa ff fi fj fo fr fy ga gd gl gn gu gv ha he hi ho hr ht hu hy hz ia id ie ig ii ik io is it iu ja jv ka kg ki kj kk kl km kn ko kr ks ku kv kw ky la lb lg li ln lo lt lu lv mg mh mi mk ml mn mr ms mt my na nb nd ne ng nl nn no nr nv ny oc oj om or os pa pi pl ps pt qu rm rn ro ru rw sa sc sd se sg si sk sl sm sn so sq sr ss st su sv sw ta te tg th ti tk tl tn to tr ts tt tw ty ug uk ur uz ve vi vo wa wo xh yi yo za zh zu".split()
)
NAMES = {
    "en": "eng english englisch anglais inglés inglese inglês", "de": "deu ger german deutsch allemand alemán tedesco alemão", "fr": "fra fre french français francais französisch francés francese francês",
    "es": "spa spanish español espanol castellano castilian spanisch espagnol spagnolo espanhol", "it": "ita italian italiano italienisch italien", "pt": "por portuguese português portugues portugiesisch portugais",
    "nl": "nld dut dutch nederlands flemish vlaams niederländisch néerlandais holländisch", "ru": "rus russian русский russisch russe ruso russo", "ko": "kor korean 한국어 한국말 koreanisch coréen coreano",
    "zh": "zho chi cmn chinese mandarin 中文 汉语 漢語 chinesisch chinois", "ja": "jpn japanese 日本語 japanisch japonais", "th": "tha thai ไทย ภาษาไทย thailändisch", "hi": "hin hindi हिन्दी हिंदी",
    "pl": "pol polish polski", "sv": "swe swedish svenska", "da": "dan danish dansk", "no": "nor norwegian norsk", "fi": "fin finnish suomi", "cs": "ces cze czech čeština", "tr": "tur turkish türkçe", "uk": "ukr ukrainian",
    "ar": "ara arabic", "he": "heb hebrew", "fa": "fas per persian farsi", "el": "ell gre greek", "hu": "hun hungarian", "ro": "ron rum romanian", "bg": "bul bulgarian", "vi": "vie vietnamese", "id": "ind indonesian", "ca": "cat catalan", "la": "lat latin",
}
_NAME_OF = {n: k for k, v in NAMES.items() for n in v.split()}


def label_of(lang: str | None) -> str | None:
    """The two-letter code that a label means: codes, names, regional forms, any letter case; None if it names no language."""
    if lang is None:
        return None
    t = re.sub(r"[\s_]+", "-", lang.strip().strip("[](){}<>\"'.").lower())
    head = re.split(r"[-;,/(]", t)[0]
    for x in (t, head):
        if x in _NAME_OF:
            return _NAME_OF[x]
        if x in CODES:
            return x
    return None


_SOLID = re.compile("[฀-๿぀-ヿ㐀-鿿豈-﫿ｦ-ﾟ]")
_LETTERS = re.compile(r"[^\W\d_]+(?:[̀-ͯऀ-ःऺ-ॏัิ-ฺ็-๎]+[^\W\d_]*)*")


def grams(chunk: str) -> list[str]:
    """The n-grams of a run without blanks: of its padded words; of scripts without blanks single characters and pairs."""
    out = []
    for w in _LETTERS.findall(chunk):
        if _SOLID.search(w):
            out += [c for c in w] + [w[i : i + 2] for i in range(len(w) - 1)]
        else:
            p = f"_{w}_"
            out += [p[i : i + n] for n in range(1, LONGEST + 1) for i in range(len(p) - n + 1) if p[i : i + n] != "_"]
    return out


def _h(gram: str) -> int:
    return zlib.crc32(gram.encode("utf-8", "surrogatepass")) % FEATURES


class _Hashes(dict):
    def __missing__(self, gram: str) -> int:
        if len(self) > MEMO:
            self.clear()
        self[gram] = n = _h(gram)
        return n


#: Runs without blanks that are no word of any language; the formula placeholder is one.
_WORDLESS = re.compile(r"[\W\d_]*(?:\[formula\][\W\d_]*)?")


@dataclass
class Model:
    """Unit centroids (features x centroids), already weighted by idf, the language of each centroid, the nearness that
    each language asks for, and margins with the share of right answers that they stand for."""

    idf: np.ndarray
    weights: np.ndarray
    owner: np.ndarray
    limits: np.ndarray
    margins: np.ndarray
    shares: np.ndarray

    def classifier(self) -> "Classifier":
        return Classifier(self)


def fit(labelled: list[tuple[str, str]], per_language: int = 400) -> Model:
    """A model of (language, text) rows, at most ``per_language`` texts each, and of the seed texts.

    Texts that stand nearer to another language's first centroid are taken for wrongly labelled and
    left out; the rest is clustered into at most three centroids per language. From the sentences of these
    texts follow the limits of nearness, and how often a margin stands for the right language.
    """
    texts: dict[str, list[str]] = defaultdict(list)
    for lang, text in labelled:
        if lang in LANGUAGES and text and len(texts[lang]) < per_language:
            texts[lang].append(text)
    for lang, seed in SEED_TEXTS.items():
        texts[lang].append(seed)
    hashes = _Hashes()
    of_chunk: dict[str, list[int]] = {}  # hashed n-grams of a run without blanks; the texts are a bounded sample
    counted: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    df = np.zeros(FEATURES)
    for lang, ts in texts.items():
        counted[lang] = []
        for t in ts:
            found: list[int] = []
            for chunk in t.lower().replace("[formula]", " ").split():
                hs = of_chunk.get(chunk)
                if hs is None:
                    hs = of_chunk[chunk] = [hashes[g] for g in grams(textform.fold(chunk))]
                found += hs
            n = np.bincount(found, minlength=FEATURES) if found else np.zeros(FEATURES, int)
            at = np.flatnonzero(n)
            df[at] += 1
            counted[lang].append((at, n[at]))
    idf = np.log((1 + sum(map(len, texts.values()))) / (1 + df)).astype(np.float32)
    # Vectors stay sparse: (features, unit weights) per text.
    vectors = {}
    for lang, cs in counted.items():
        ws = [n * idf[at] for at, n in cs]
        vectors[lang] = [(at, w / max(float(np.linalg.norm(w)), 1e-9)) for (at, _), w in zip(cs, ws)]

    def centre(vs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        c = np.zeros(FEATURES)
        for at, w in vs:
            c[at] += w
        return c / max(float(np.linalg.norm(c)), 1e-9)

    def nearness(vs: list[tuple[np.ndarray, np.ndarray]], centres: list[np.ndarray]) -> np.ndarray:
        m = np.stack(centres)
        return np.stack([m[:, at] @ w for at, w in vs])

    first = {}
    for k, v in vectors.items():  # the median-like centre: a mean of the texts nearest to the plain mean
        near = nearness(v, [centre(v)])[:, 0]
        inner = [x for x, d in zip(v, near) if d >= np.median(near)]
        first[k] = centre([*inner, (v[-1][0], 0.2 * len(inner) * v[-1][1])])
    names = list(vectors)
    base = [first[k] for k in names]
    columns, owner = [], []
    kept: list[tuple[str, str]] = []
    for k in names:
        v = vectors[k]
        right = np.argmax(nearness(v, base), 1) == names.index(k)
        kept += [(k, t) for t, ok in zip(texts[k][:-1], right) if ok]
        own = [x for x, ok in zip(v, right) if ok] or v[-1:]
        centres = [centre(own)]
        while len(centres) < min(CENTROIDS, len(own)):
            centres.append(centre([own[int(np.argmin(np.max(nearness(own, centres), 1)))]]))
        for _ in range(8):
            at = np.argmax(nearness(own, centres), 1)
            centres = [centre([x for x, j in zip(own, at) if j == i]) if (at == i).any() else c for i, c in enumerate(centres)]
        columns += centres
        owner += [LANGUAGES.index(k)] * len(centres)
    weights = np.stack(columns).T * idf[:, None]
    model = Model(idf, np.ascontiguousarray(weights, np.float32), np.array(owner), np.full(len(LANGUAGES), REJECT), np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    return _calibrated(model, kept)


def _calibrated(model: Model, kept: list[tuple[str, str]]) -> Model:
    """``model`` with the limits and margins that the sentences of labelled texts give."""
    from foliospark.llm.p4_sentences import split_sentences

    own, sentences = [], []
    for k, t in kept:
        found = split_sentences(t)
        sentences += found
        own += [LANGUAGES.index(k)] * len(found)
    lang, margin, letters, near = model.classifier().per_text(sentences)
    own, enough = np.array(own, int), letters >= LEAST_FITTED_LETTERS
    for k in range(len(LANGUAGES)):
        mine = near[enough & (own == k) & (lang == k)]
        if len(mine) >= LEAST_FITTED:
            model.limits[k] = max(REJECT, REJECT_SHARE * float(np.quantile(mine, REJECT_QUANTILE)))
    if enough.sum() >= LEAST_FITTED * len(LANGUAGES):
        # Isotonic: pool neighbours of 50 margins each until the share of right answers rises with the margin.
        order = np.argsort(margin[enough])
        hits, at = (lang == own)[enough][order], margin[enough][order]
        blocks: list[list[float]] = []
        for i in range(0, len(at), 50):
            blocks.append([float(hits[i : i + 50].sum()), float(len(hits[i : i + 50])), float(at[i : i + 50].sum())])
            while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
                last = blocks.pop()
                blocks[-1] = [x + y for x, y in zip(blocks[-1], last)]
        model.margins, model.shares = np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])
    return model


class Classifier:
    """Scores texts with a model; remembers the scores of words."""

    def __init__(self, model: Model):
        self.model = model
        self.k = len(model.owner)
        self.first = np.array([np.flatnonzero(model.owner == i)[0] for i in range(len(LANGUAGES))])
        order = np.argsort(model.owner, kind="stable")
        self._hash = _Hashes()
        self._order, self._starts = order, np.searchsorted(model.owner[order], np.arange(len(LANGUAGES)))
        self._forget()

    def _forget(self) -> None:
        self._rows = np.zeros((1024, self.k + 2), np.float32)  # scores, length of the word's vector, letters
        self._used = 0
        classifier = self

        class Memo(dict):
            def __missing__(self, chunk: str) -> int:
                n = 0 if _WORDLESS.fullmatch(chunk) else classifier._add(chunk)
                if len(chunk) < 40:
                    self[chunk] = n
                return n

        self.memo = Memo()
        self._used = 1  # the first row is that of chunks without letters

    def _add(self, chunk: str) -> int:
        if self._used == len(self._rows):
            self._rows = np.concatenate([self._rows, np.zeros_like(self._rows)])
        n = self._used
        hashes = self._hash
        hs = [hashes[g] for g in grams(textform.fold(chunk))]
        if hs:
            self._rows[n, : self.k] = self.model.weights[hs].sum(0)
            u, c = np.unique(hs, return_counts=True)
            self._rows[n, self.k] = np.sqrt(((c * self.model.idf[u]) ** 2).sum())
            self._rows[n, self.k + 1] = sum(ch.isalpha() for ch in chunk)
        self._used += 1
        return n

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(scores of all words, first word of each text): for sums over any stretches."""
        if self._used > MEMO:
            self._forget()
        get = self.memo.__getitem__
        at: list[int] = []
        starts = []
        for t in texts:
            starts.append(len(at))
            at += map(get, t.lower().split())
        return self._rows[at], np.array(starts)

    def per_text(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(language number or -1, margin, letters, nearness) of every text.

        Nearness is the mean cosine of a text's words to the centroid, weighted by the lengths of their
        vectors; unlike that of the whole text it doesn't grow with length, so one limit fits all. The
        margin says by how much the next language is farther off.
        """
        if not texts:
            return (np.zeros(0, int), np.zeros(0), np.zeros(0), np.zeros(0))
        rows, starts = self.words(texts)
        sums = np.zeros((len(texts), self.k + 2), np.float32)
        stops = np.append(starts[1:], len(rows))
        full = np.flatnonzero(stops > starts)
        if len(full):
            sums[full] = np.add.reduceat(rows, starts[full], 0)
        score = np.maximum.reduceat(sums[:, : self.k][:, self._order], self._starts, 1)
        best = np.argmax(score, 1)
        top = score[np.arange(len(texts)), best]
        score[np.arange(len(texts)), best] = -1
        second = np.maximum(score.max(1), 0)
        near = top / np.maximum(sums[:, self.k], 1e-9)
        lang = np.where((top > 0) & (near >= self.model.limits[best]), best, -1)
        margin = np.where(top > 0, (top - second) / np.maximum(top, 1e-9), 0.0)
        return lang, np.clip(margin, 0, 1), sums[:, self.k + 1], near

    def beyond_doubt(self, lang: str, near: float) -> bool:
        """Whether a text is as near to ``lang`` as nearly all labelled sentences of it are."""
        return near >= self.model.limits[LANGUAGES.index(lang)] * DOUBT_SHARE / REJECT_SHARE

    def confidence(self, margin: float) -> float:
        """The share of right answers among labelled sentences of such a margin."""
        return float(np.interp(margin, self.model.margins, self.model.shares))
