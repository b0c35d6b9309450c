"""The language of documents and of the stretches of mixed-language documents.

Error-correcting output codes: every language has a codeword, and for every bit a binary classifier over the character
n-grams of a word predicts that bit. A word's bits are decoded by loss against all codewords, bits that err more on
the fitting sample weigh less, and the stretches of a text are the cheapest path through the languages, word by word,
with a price on changing the language. A small margin between the two nearest codewords flags ambiguity.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Labelled rows per language that the classifiers are fitted on: all up to this number, beyond it about this number,
#: drawn evenly by the hash of the text, copies once. Texts over ``FIT_CHARS`` are not drawn.
FIT_ROWS = 150
#: Seed words at most; a larger table is refused.
FIT_SEEDS = 100_000
FIT_CHARS = 20_000
BUCKETS = 1 << 16
BITS = 15
#: Price of changing the language between two words, in units of a word's loss.
SWITCH = 6.0
#: Words that a stretch must have in a row to make a text mixed.
LEAST_WORDS = 15

#: Fixed: ISO 639 codes of the ten languages and their English names.
CODES = {
    "en": ("eng", "english"), "de": ("deu", "ger", "german"), "fr": ("fra", "fre", "french"), "es": ("spa", "spanish"), "pt": ("por", "portuguese"),
    "it": ("ita", "italian"), "nl": ("nld", "dut", "dutch"), "sv": ("swe", "swedish"), "ru": ("rus", "russian"), "hi": ("hin", "hindi"),
}
#: Fixed: codes that name no language.
NO_LANGUAGE = ("und", "unk", "mul", "mis", "zxx", "nan", "nil", "na", "no", "xx", "xxx", "tbd", "any")
_NAMES = {alias: code for code, aliases in CODES.items() for alias in (code, *aliases)}

_NOTE = re.compile(r"\[[^\[\]\n]{0,60}\]|\([^()\n]{0,40}\)|【[^【】\n]{0,40}】|<[^<>\n]{0,80}>|\*[^*\s][^*\n]{0,30}\*|[♪♫]")
_TIME = re.compile(r"\d{1,3}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?(?:\s*-->\s*)?")
_ALNUM = re.compile(r"[^\W_]")
_LETTERS = re.compile(r"[^\W\d_](?:[^\W\d_]|[\u0300-\u036f\u0900-\u0dff\u200c\u200d'’])*")


def language_of_code(code: str | None) -> str | None:
    """The two-letter code that a label names, in any spelling, region or length; None if it names no language.

    A language outside the ten is named by its own code in lower case.
    """
    if code is None:
        return None
    first = re.split(r"[-_\s.,;/()@]", code.strip().lower())[0]
    if first in _NAMES:
        return _NAMES[first]
    return first if re.fullmatch("[a-z]{2,3}", first) and first not in NO_LANGUAGE else None


def words_of(text: str | None) -> list[str]:
    """Words as white space separates them, sound annotations, markup and times left out."""
    if not text:
        return []
    text = _TIME.sub(" ", _NOTE.sub(" ", html.unescape(text)))
    return [w for w in text.split() if _ALNUM.search(w)]


@lru_cache(maxsize=400_000)
def _grams(word: str) -> tuple[int, ...]:
    """Buckets of the character n-grams (1 to 4, with word ends) and of the whole word; none for a word without letters."""
    m = _LETTERS.search(word.lower())
    if not m:
        return ()
    w = f"<{m[0]}>"
    grams = {w, *(w[i : i + n] for n in (2, 3, 4) for i in range(len(w) - n + 1)), *m[0]}
    return tuple(xxhash.xxh64_intdigest(g) % BUCKETS for g in sorted(grams))


def codewords(n: int, bits: int = BITS) -> np.ndarray:
    """``n`` words of +1/-1 with distinct columns, as far apart as the best of many fixed draws; each bit splits evenly."""
    r = np.random.default_rng(7)
    best, score = None, (-1, -1.0)
    half = np.array([1] * ((n + 1) // 2) + [-1] * (n // 2))
    for _ in range(2000):
        m = np.stack([r.permutation(half) for _ in range(bits)], axis=1)
        d = (m[:, None, :] != m[None, :, :]).sum(axis=2) + np.eye(n, dtype=int) * bits
        now = (int(d.min()), float(d.mean()))
        if now > score:
            best, score = m, now
    return best.astype(np.float32)


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray  # BUCKETS x bits
    trust: np.ndarray  # weight of each bit's loss
    known: dict[str, int] = field(default_factory=dict)
    table: np.ndarray | None = None

    def __getstate__(self):
        return {"languages": self.languages, "codes": self.codes, "weights": self.weights, "trust": self.trust}

    def __setstate__(self, state):
        self.__dict__.update(state, known={}, table=None)

    def _loss(self, word: str) -> np.ndarray:
        """Loss of the word against each language's codeword: 0 for the nearest, 3 at most; zeros without letters."""
        grams = _grams(word)
        if not grams:
            return np.zeros(len(self.languages), np.float32)
        margin = self.weights[list(grams)].sum(axis=0) / np.sqrt(len(grams))
        loss = (np.log1p(np.exp(-np.clip(self.codes * margin, -20, 20))) * self.trust).sum(axis=1)
        return np.minimum(loss - loss.min(), 3.0)

    def losses(self, words: list[str]) -> np.ndarray:
        """Words x languages. Word losses are kept between texts, up to a bounded number of words."""
        if len(self.known) > 300_000:
            self.known, self.table = {}, None
        known = self.known
        new = list(dict.fromkeys(w for w in words if w not in known))
        if self.table is None:
            self.table = np.zeros((1024, len(self.languages)), np.float32)
        while len(known) + len(new) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        for w in new:
            self.table[len(known)] = self._loss(w)
            known[w] = len(known)
        return self.table[[known[w] for w in words]]


def fit(samples: list[tuple[list[str], str]], languages: list[str], seeds: dict[str, list[str]] | None = None, rounds: int = 24, passes: int = 2) -> Model:
    """Classifiers from labelled word lists. After each pass but the last, the samples' stretches are labelled anew.

    ``seeds``: words that are known to belong to a language; they join every pass.
    """
    codes = codewords(len(languages))
    index = {x: i for i, x in enumerate(languages)}
    units = [(words, index[x]) for words, x in samples if x in index]
    model = None
    for p in range(passes):
        counts: dict[str, np.ndarray] = {}
        for words, i in units:
            for w in words:
                w = w.lower()
                if w not in counts:
                    counts[w] = np.zeros(len(languages))
                counts[w][i] += 1
        for x, words in (seeds or {}).items():
            if x in index:
                for w in words:
                    counts.setdefault(w.lower(), np.zeros(len(languages)))[index[x]] += 5
        model = _fit_words(counts, codes, languages, rounds if p == passes - 1 else rounds // 2)  # the first only cleans labels
        if p < passes - 1:
            units = [(words[a:b], i) for words, _ in units for i, a, b in stretches(words, model)]
    return model


def _fit_words(counts: dict[str, np.ndarray], codes: np.ndarray, languages: list[str], rounds: int) -> Model:
    """Logistic regression of every bit on word types, weighted by how often they stand in each language."""
    words = [w for w in counts if _grams(w)]
    n_bits = codes.shape[1]
    weights = np.zeros((BUCKETS, n_bits), np.float32)
    if not words:
        return Model(languages, codes, weights, np.ones(n_bits, np.float32))
    c = np.stack([counts[w] for w in words])
    c = c / np.maximum(c.sum(axis=0), 1.0)  # languages count alike, however many words they have
    c = np.sqrt(c * len(words))
    mass = c.sum(axis=1)
    share = c / mass[:, None]
    target = share @ ((codes + 1) / 2)  # probability of bit +1 for each word type
    grams = [_grams(w) for w in words]
    flat = np.fromiter((g for x in grams for g in x), np.int64)
    sizes = np.array([len(x) for x in grams])
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    order = np.argsort(flat, kind="stable")
    used, first = np.unique(flat[order], return_index=True)
    owner = np.repeat(np.arange(len(words)), sizes)[order]
    scale = (1 / np.sqrt(sizes)).astype(np.float32)[:, None]
    local = np.searchsorted(used, flat)
    w = np.zeros((len(used), n_bits), np.float32)
    g2 = np.full_like(w, 1e-6)
    heft = (mass / mass.mean()).astype(np.float32)[:, None]
    for _ in range(rounds):
        margin = np.add.reduceat(w[local], starts, axis=0) * scale
        error = (1 / (1 + np.exp(-margin)) - target) * heft
        grad = np.add.reduceat((error * scale).astype(np.float32)[owner], first, axis=0) + 1e-3 * w
        g2 += grad**2
        w -= 0.5 * grad / np.sqrt(g2)
    margin = np.add.reduceat(w[local], starts, axis=0) * scale
    wrong = (np.abs((margin > 0) - target) * mass[:, None]).sum(axis=0) / mass.sum()
    trust = np.log((1 - wrong + 0.01) / (wrong + 0.01)).clip(0.05)
    weights[used] = w
    return Model(languages, codes, weights, (trust / trust.mean()).astype(np.float32) / n_bits * 4)


def stretches(words: list[str], model: Model, switch: float = SWITCH) -> list[tuple[int, int, int]]:
    """(language index, first word, end word) of the cheapest path through the languages."""
    return path(model.losses(words), switch) if words else []


def path(loss: np.ndarray, switch: float = SWITCH) -> list[tuple[int, int, int]]:
    """The cheapest path through the columns of ``loss``, where changing the column costs ``switch``."""
    n, k = loss.shape
    best = int(loss.sum(axis=0).argmin())
    # c changes bound c + 1 stretches: if no stretch saves more than half of what a change costs, none pays.
    saved = np.cumsum(loss[:, best, None] - loss, axis=0, dtype=np.float64)
    low = np.minimum(np.minimum.accumulate(saved, axis=0), 0.0)
    if 2 * (saved - low).max() <= switch:
        return [(best, 0, n)]
    back = np.empty((n, k), np.int16)
    cost = loss[0].astype(np.float64)
    own = np.arange(k)
    for i in range(1, n):
        low = int(cost.argmin())
        move = cost[low] + switch < cost
        back[i] = np.where(move, low, own)
        cost = np.where(move, cost[low] + switch, cost) + loss[i]
    state, out, end = int(cost.argmin()), [], n
    for i in range(n - 1, 0, -1):
        prev = int(back[i][state])
        if prev != state:
            out.append((state, i, end))
            end, state = i, prev
    out.append((state, 0, end))
    return out[::-1]


def describe(text: str | None, model: Model, least: int = LEAST_WORDS) -> dict | None:
    """Main language, confidence, ambiguity and stretches of one text; None for a text without words.

    The main language is that of most words. Stretches shorter than ``least`` words (quotations) go to the stretch
    before them, at the front to the main language. Confidence is the share of words decoded to the main language
    times how clearly its longest stretch was.
    """
    words = words_of(text)
    if not words:
        return None
    loss = model.losses(words)
    parts = path(loss)
    count = np.zeros(len(model.languages))
    for i, a, b in parts:
        count[i] += b - a
    main = int(count.argmax())
    runs: list[list[int]] = []
    for i, a, b in parts:
        if b - a < least:
            i = runs[-1][0] if runs else main
        if runs and runs[-1][0] == i:
            runs[-1][2] = b
        else:
            runs.append([i, a, b])

    def sure(i: int, a: int, b: int) -> float:
        total = loss[a:b].sum(axis=0, dtype=np.float64)
        other = np.delete(total, i).min() if len(total) > 1 else total[i]
        return float(1 / (1 + np.exp(-np.clip((other - total[i]) / np.sqrt(b - a), -30, 30))))

    segments = [{"language": model.languages[i], "first_word": a, "n_words": b - a, "confidence": round(sure(i, a, b), 4)} for i, a, b in runs]
    longest = max((s for s in segments if s["language"] == model.languages[main]), key=lambda s: s["n_words"], default=None)
    confidence = round(float(count[main] / count.sum()) * (longest["confidence"] if longest else 0.5), 4)
    return {"language": model.languages[main], "confidence": confidence, "ambiguous": confidence < 0.6, "n_words": len(words), "segments": segments}


SEGMENT = T.StructType([T.StructField("language", T.StringType()), T.StructField("first_word", T.IntegerType()), T.StructField("n_words", T.IntegerType()), T.StructField("confidence", T.DoubleType())])
RESULT = T.StructType([T.StructField("language", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("ambiguous", T.BooleanType()), T.StructField("n_words", T.IntegerType()), T.StructField("segments", T.ArrayType(SEGMENT))])
_ARROW = pa.struct([("language", pa.string()), ("confidence", pa.float64()), ("ambiguous", pa.bool_()), ("n_words", pa.int32()), ("segments", pa.list_(pa.struct([("language", pa.string()), ("first_word", pa.int32()), ("n_words", pa.int32()), ("confidence", pa.float64())])))])


@F.arrow_udf(T.StringType())
def named_language(codes: pa.Array) -> pa.Array:
    """Column form of ``language_of_code``."""
    return pa.array([language_of_code(c) for c in codes.to_pylist()], pa.string())


def _named(code: str) -> Column:
    """The language of ``CODES`` that a label names, as ``language_of_code``, inside the JVM; null for any other label."""
    first = F.get(F.split(F.lower(F.trim(F.regexp_replace(code, r"(?U)^\s+|\s+$", ""))), r"[-_\s.,;/()@]"), F.lit(0))
    return F.element_at(F.create_map(*[F.lit(x) for pair in _NAMES.items() for x in pair]), first)


def fit_on(labelled: DataFrame, text: str, code: str, seeds: DataFrame | None = None, rows: int = FIT_ROWS, most_seeds: int = FIT_SEEDS) -> Model:
    """A model fitted on a bounded sample of labelled texts (see ``FIT_ROWS``); ``seeds`` has ``lang, word``.

    Copies of a text count once in the sample. A table of more than ``most_seeds`` seed words is refused.
    """
    known = labelled.select(F.col(text).alias("x"), _named(code).alias("lang")).filter(F.col("x").isNotNull() & (F.length("x") <= FIT_CHARS) & F.col("lang").isNotNull())
    have = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # at most the ten languages
    h = F.pmod(F.xxhash64("x"), F.lit(1_000_000))
    draw = F.lit(False)
    for lang, n in sorted(have.items()):
        draw = draw | ((F.col("lang") == lang) & (h < F.lit(round(min(1.0, rows / n) * 1_000_000))))
    # Copies are folded in the map tasks; no more than twice the wanted number of a language is sent, whatever was drawn.
    drawn = known.filter(draw).groupBy("lang", F.xxhash64("x").alias("h")).agg(F.min("x").alias("x"))
    drawn = drawn.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("h", "x"))).filter(F.col("nth") <= 2 * rows)
    samples = [(words_of(r["x"]), r["lang"]) for r in drawn.collect()]
    words: dict[str, list[str]] = {}
    if seeds is not None:
        found = seeds.filter("lang IS NOT NULL AND word IS NOT NULL").select("lang", "word").distinct().limit(most_seeds + 1).collect()
        if len(found) > most_seeds:
            raise ValueError(f"more than {most_seeds} seed words")
        for r in sorted(found):
            words.setdefault(r["lang"], []).append(r["word"])
    return fit(sorted(samples), list(CODES), words)


def detect(df: DataFrame, item_id: str, text: str, model: Model) -> DataFrame:
    """``item_id, d``: language, confidence, ambiguous, n_words, segments; ``d`` is null for texts without words.

    Every row is judged by its whole text. Null, empty, wordless texts give null; repeated rows stay; an empty table
    gives an empty result; other columns are left out, whatever their names.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # fixed size: BUCKETS x BITS floats

    @F.arrow_udf(RESULT)
    def judge(texts: pa.Array) -> pa.Array:
        return pa.array([describe(t, shared.value) for t in texts.to_pylist()], _ARROW)

    # Not taken for deterministic, so that the planner does not evaluate it again for filters on its result.
    return df.select(F.col(f"`{item_id}`"), judge.asNondeterministic()(F.col(f"`{text}`")).alias("d"))
