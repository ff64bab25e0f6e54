"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of a lexicon (a fixed seed list, and words and stems learned from labelled
rows, for languages that the list lacks), hits near a second-person pronoun, capitals, punctuation, obfuscated spellings and length.
Training takes at most ``sample`` labelled rows, chosen by a hash of their id: three quarters of
them fit the lexicon and trees, the quarter left out fits the calibration. A few fixed sentences are always learned from too, so that
there is a model without labels or with those of one class only. Scoring is one pass over the texts with no shuffle.

A null or blank text has all features zero and gets the model's score for that; rows without a
label are scored alike; labels with null toxic are not learned from; a label on several texts, or several labels of one, count each
(of very many repeated rows twice the sample at most). Very long texts are measured whole; equal texts get equal scores; repeated rows stay;
an empty table gives an empty result; other columns of any name do no harm.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelight.llm.common import COMMON_WORDS, filtered, quoted, text_batches

SAMPLE, THRESHOLD = 20_000, 0.7
#: Letters that a stem has, and what a learned word or stem must have: so much evidence (nats, over the share of toxic texts), in
#: so many toxic texts, which are so much of all that have it. At most so many are learned.
STEM, EVIDENCE, LEAST, SHARE, LEARNED = 5, 13.0, 4, 0.8, 400
#: Seed lexicon and second-person pronouns in the corpus's languages (fixed word lists).
LEXICON = frozenset("idiot moron stupid scum trash loser pathetic disgusting worthless clown dumb imbecile ignorant connard imbécile débile ordure minable trottel dummkopf abschaum idiota estúpido basura imbécil patético".split())
SECOND = frozenset("you your yours yourself u ur tu toi te ton vous votre du dich dir dein ihr euch tú ti usted vosotros".split())
_WORD = re.compile(r"[^\W\d_]+")
_MASKED = re.compile(r"\b[^\W\d_]+[@$!*0134578]+[^\W\d_]+\b|\b(?:[^\W\d_][.\-_*]){3,}[^\W\d_]\b")
_PLAIN = str.maketrans("@$!013457*", "asioleasti")
N_FEATURES = 12


def _stem(word: str) -> str:
    """A longer word's beginning, as a lexicon entry."""
    return word[:STEM] + "*"


def entries(text: str) -> set[str]:
    """The words of a text and the stems of its longer words."""
    words = set(_WORD.findall(text.lower()))
    return words | {_stem(w) for w in words if len(w) > STEM}


def features(text: str, learned: frozenset = frozenset()) -> list[float]:
    words = _WORD.findall(text.lower())
    n = max(len(words), 1)
    kinds = set(words)
    masked = _MASKED.findall(text)
    undone = [re.sub(r"[^\w]", "", m.lower().translate(_PLAIN)) for m in masked]
    hidden = sum(w in LEXICON or w in learned or _stem(w) in learned for w in undone)
    seed = own = near = 0
    seed_kinds, own_kinds = kinds & LEXICON, {w for w in kinds if w in learned or (len(w) > STEM and _stem(w) in learned)} if learned else kinds & learned
    if seed_kinds or own_kinds:
        hits = [i for i, w in enumerate(words) if w in seed_kinds or w in own_kinds]
        seed = sum(words[i] in seed_kinds for i in hits)
        own = sum(words[i] in own_kinds for i in hits)
        near = sum(not SECOND.isdisjoint(words[max(0, i - 5) : i + 6]) for i in hits)
    second = sum(map(words.count, kinds & SECOND)) if kinds & SECOND else 0
    chars = max(len(text), 1)
    return [
        seed / n, float(len(seed_kinds)), own / n, float(len(own_kinds)), near / n, second / n,
        sum(map(str.isupper, text)) / chars,
        (text.count("!") + text.count("?")) / chars, (text.count(".") + text.count(",")) / chars,
        len(masked) / n, float(hidden), float(np.log1p(len(words))),
    ]


# --- model --------------------------------------------------------------------------------------


class Trees:
    """Boosted regression trees on the logistic loss, split on quantile bins."""

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 32, ridge: float = 1.0) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.ridge = rounds, depth, rate, bins, ridge
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n, k = x.shape
        cuts = [np.unique(np.quantile(c[c > 0] if (c > 0).any() else c, np.linspace(0, 1, self.bins))) for c in x.T]
        cuts = [np.unique(np.concatenate(([0.0], c))) for c in cuts]
        binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)])
        width = max(map(len, cuts)) + 1
        p0 = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        self.base = float(np.log(p0 / (1 - p0)))
        margin = np.full(n, self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, p * (1 - p)
            nodes = 2 ** (self.depth + 1) - 1
            feature, cut, value = np.full(nodes, -1), np.zeros(nodes), np.zeros(nodes)
            where = np.zeros(n, np.int64)
            for node in range(nodes):
                at = np.nonzero(where == node)[0]
                if not len(at):
                    continue
                sg, sh = g[at].sum(), h[at].sum()
                value[node] = -self.rate * sg / (sh + self.ridge)
                if node >= 2**self.depth - 1 or len(at) < 8:
                    continue
                best = (1e-6, -1, 0)
                for f in range(k):
                    gl = np.cumsum(np.bincount(binned[f, at], g[at], width))[:-1]
                    hl = np.cumsum(np.bincount(binned[f, at], h[at], width))[:-1]
                    gain = gl**2 / (hl + self.ridge) + (sg - gl) ** 2 / (sh - hl + self.ridge) - sg**2 / (sh + self.ridge)
                    b = int(np.argmax(gain[: len(cuts[f])]))
                    if gain[b] > best[0]:
                        best = (gain[b], f, b)
                if best[1] >= 0:
                    feature[node], cut[node] = best[1], cuts[best[1]][best[2]]
                    where[at] = 2 * node + 1 + (binned[best[1], at] > best[2])
            margin += value[where]
            self.trees.append((feature, cut, value))
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                node = np.where(f >= 0, 2 * node + 1 + (x[rows, f] > cut[node]), node)
            out += value[node]
        return out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (scores, calibrated values), to be interpolated."""
    order = np.argsort(score, kind="stable")
    s, inverse = np.unique(score[order], return_inverse=True)
    weight = np.bincount(inverse).astype(float)
    mean = np.bincount(inverse, y[order]) / weight
    blocks: list[list[float]] = []
    for i in range(len(s)):
        blocks.append([mean[i], weight[i], i, i])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m, w, _, last = blocks.pop()
            b = blocks[-1]
            b[0], b[1], b[3] = (b[0] * b[1] + m * w) / (b[1] + w), b[1] + w, last
    # each step at the mean score of its rows, so that values in between are told apart
    xs, ys = [], []
    for m, w, a, b in blocks:
        xs.append(float((s[a : b + 1] * weight[a : b + 1]).sum() / w))
        ys.append(m)
    return np.array(xs), np.array(ys)


class ToxicityModel:
    def __init__(self, learned: frozenset, trees: Trees, steps: tuple[np.ndarray, np.ndarray]) -> None:
        self.learned, self.trees, self.steps = learned, trees, steps

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.trees.margin(x), *self.steps), 0.0, 1.0)


def prior_rows() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of fixed sentences, insults and plain words: what the trees know without labels."""
    rude = [f"you are a {w} and everyone knows it" for w in sorted(LEXICON)]
    calm = [" ".join(COMMON_WORDS[(7 * i + 3 * j) % len(COMMON_WORDS)] for j in range(12)) for i in range(len(rude) - 2)] + ["", "you and your friends"]
    return np.array([features(t) for t in rude + calm]), np.array([1.0] * len(rude) + [0.0] * len(calm))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ToxicityModel:
    """A model from labelled rows outside the held-out fold (crc32 of the id as text, modulo 3, equal to 1)."""
    text_batches(docs.sparkSession)
    known = labels.where("toxic is not null and doc_id is not null").select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_toxic"))
    fold = F.crc32(F.col("_id").cast("string").cast("binary")) % 3
    rows = known.where(fold != 1).orderBy(F.xxhash64("_id"), "_id").limit(sample)

    def words(batches):
        for b in batches:
            texts = [x.as_py() or "" for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([list(entries(t)) for t in texts], pa.list_(pa.string()))], ["_id", "_toxic", "words"])

    # at most `sample` ids, so the broadcast is bounded
    texts = docs.select(F.col("doc_id").alias("_d"), F.col("text").cast("string").alias("_t")).join(F.broadcast(rows), F.col("_d") == F.col("_id")).select("_id", "_toxic", "_t")
    texts = texts.select(F.col("_id").cast("string").alias("_id"), "_toxic", "_t")
    half = F.crc32(F.concat(F.lit("part:"), F.col("_id")).cast("binary")) % 4
    fit = texts.where(half != 3)
    counted = fit.mapInArrow(words, "_id string, _toxic int, words array<string>").select("_toxic", F.explode("words").alias("word")).groupBy("word").agg(F.sum("_toxic").alias("bad"), F.count("*").alias("n"))
    toxic = rows.agg(F.avg("_toxic")).first()[0] or 0.5  # of at most `sample` labels
    evidence = F.col("bad") * F.log(F.col("bad") / F.col("n") / toxic)
    good = (F.col("bad") >= LEAST) & (F.col("bad") >= SHARE * F.col("n"))
    top = counted.where(good & (evidence >= EVIDENCE)).orderBy(evidence.desc(), "word").limit(LEARNED).collect()
    learned = frozenset(r["word"] for r in top) - LEXICON

    def measure(batches):
        for b in batches:
            x = [features(t.as_py() or "", learned) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.list_(pa.float64()))], ["_id", "_toxic", "x"])

    data = texts.mapInArrow(measure, "_id string, _toxic int, x array<double>").select((half == 3).alias("held"), "_toxic", "x", "_id").orderBy("_id", "x").limit(2 * sample).toArrow()
    own, known = prior_rows()
    x = np.concatenate((np.array(data.column("x").to_pylist(), float).reshape(-1, N_FEATURES), own))
    y = np.concatenate((np.array(data.column("_toxic").to_pylist(), float), known))
    held = np.concatenate((np.array(data.column("held").to_pylist(), bool), np.arange(len(own)) % 4 == 3))
    trees = Trees().fit(x[~held], y[~held])
    return ToxicityModel(learned, trees, isotonic(trees.margin(x[held]), y[held]))


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id_col, held_out, score, predicted) of every row."""
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        m = shared.value
        for b in batches:
            s = m.scores(np.array([features(t.as_py() or "", m.learned) for t in b.column(2)], float).reshape(-1, N_FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], [id_col, "held_out", "score", "predicted"])

    held = F.coalesce(F.crc32(F.col(quoted(id_col)).cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return docs.select(F.col(quoted(id_col)), held.alias("held_out"), F.col(quoted(text_col)).cast("string").alias("_t")).mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")


def keep_civil(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below threshold, all columns as they are."""
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        m = shared.value
        for b in batches:
            s = m.scores(np.array([features(t.as_py() or "", m.learned) for t in b.column(at)], float).reshape(-1, N_FEATURES))
            yield b.filter(pa.array(s < threshold))

    return filtered(docs, run)
