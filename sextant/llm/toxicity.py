"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

The lexicon is learned: words and word beginnings (5 and 6 letters) that labelled toxic documents use far more
often than others, beside a few fixed insults. Features are its densities, how near a hit stands to a
second-person pronoun, capitals, punctuation, obfuscation and repetition. Only the text is an input.

Fitting reads at most SAMPLE labelled documents (those with the least hashed ids; the documented bound), one row each (of rows with one id the
text with the least hash), whose ids are broadcast; scoring reads all documents in one pass without a shuffle. Of the sample, every fourth document
(by its hashed id) is kept for the calibration: neither the lexicon nor the trees see its label. The lexicon is chosen among the LEXICON_POOL terms
that most exclusively stand in toxic documents; it keeps LEXICON of them.

Null texts count as empty and are scored like empty ones; texts of any length are read whole; an empty table gives no rows. Ties in
the choice of terms go to the term that sorts first. Labels that are null are no labels; of several labels of a document
the highest counts; rows with one doc_id are rows like any other. Without labels of both kinds every score is the
labels' mean (0 without labels). Columns of docs pass through; clashing names give way to the results.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import dropped, pieces, staged

SAMPLE, LEXICON, LEXICON_POOL, LEAST_SUPPORT, TREES, DEPTH, RATE, BINS, LEAF = 20_000, 400, 8_000, 6, 120, 3, 0.15, 32, 12

# Common insults, and second-person words in English, French, German and Spanish.
INSULTS = {"idiot", "moron", "stupid", "dumb", "loser", "scum", "trash", "garbage", "pathetic", "worthless", "disgusting", "clown", "fool", "imbecile", "hate", "shut", "ugly", "freak"}
YOU = {"you", "your", "yours", "yourself", "u", "ur", "tu", "toi", "ton", "ta", "tes", "vous", "votre", "vos", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "euer", "te", "ti", "tus", "usted", "ustedes", "vosotros"}
LEET = str.maketrans("0134578@$!", "oieastbasi")

WORD = re.compile(r"[^\W_]+(?:[*@$!_][^\W_]+)*")
ODD = re.compile(r"[^\W\d_][\d*@$!_]+[^\W\d_]")
LONG = re.compile(r"([^\W\d_])\1{3,}")
NAMES = ("hits", "hit_density", "weight_density", "weight_most", "distinct_hits", "you_density", "near_you", "capitals", "exclaimed", "punctuation", "obfuscated", "elongated", "distinct_words", "words", "word_length", "most_repeated")


class Lexicon(dict):
    """Weight of a word, and whether it is a second-person word; looked up once for each word in a while."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) > 300_000:
            self.clear()
        low = word.lower()
        w = self.weight(low)
        if not w and ODD.search(low):
            w = self.weight(re.sub(r"[\W_]+", "", low.translate(LEET)))
        self[word] = w = -1.0 if not w and low in YOU else w
        return w

    def weight(self, low: str) -> float:
        get = self.weights.get
        return max(get(low, 0.0), get(low[:5] + "~", 0.0) if len(low) >= 5 else 0.0, get(low[:6] + "~", 0.0) if len(low) >= 6 else 0.0)


def features(texts: list[str], lexicon: Lexicon) -> np.ndarray:
    out = np.zeros((len(texts), len(NAMES)), np.float64)
    for row, text in zip(out, texts, strict=True):
        words = WORD.findall(text)
        n = len(words)
        if not n:
            continue
        w = np.array([lexicon[x] for x in words])
        hits, you = np.flatnonzero(w > 0), np.flatnonzero(w < 0)
        if len(hits):
            row[0], row[1] = np.log1p(len(hits)), len(hits) / n
            row[2], row[3] = w[hits].sum() / n, w[hits].max()
            row[4] = len({words[i] for i in hits.tolist()})
            if len(you):
                at = np.searchsorted(you, hits)
                gap = np.minimum(np.abs(hits - you[np.minimum(at, len(you) - 1)]), np.abs(hits - you[np.maximum(at - 1, 0)])).min()
                row[6] = 1 / (1 + gap)
        counts = Counter(words)
        row[5] = len(you) / n
        row[7] = sum(c for x, c in counts.items() if len(x) > 2 and x.isupper()) / n
        row[8] = text.count("!") / n
        row[9] = sum(map(text.count, ".,;:?*#%&$")) / n
        row[10] = sum(c for x, c in counts.items() if ODD.search(x)) / n
        row[11] = sum(c for x, c in counts.items() if LONG.search(x)) / n
        row[12], row[13], row[14] = len(counts) / n, np.log1p(n), len(text) / n
        row[15] = max(counts.values()) / n
    return out


def learned_weights(found: list[tuple[str, int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Log-odds of the terms (term, toxic documents, clean documents) that speak for toxicity."""
    scored = []
    for term, t, c in found:
        if t >= LEAST_SUPPORT:
            odds = np.log((t + 0.5) / (toxic + 1)) - np.log((c + 0.5) / (clean + 1))
            if odds > 1.5:
                scored.append((-float(odds), term))
    return {term: -odds for odds, term in sorted(scored)[:LEXICON]}


@dataclass
class Boosted:
    """Trees of depth DEPTH as heaps of (feature, threshold), with the leaves' values."""

    base: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for which, cut, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, which[node]] > cut[node])
            out += leaf[node - (2**DEPTH - 1)]
        return out

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray) -> Boosted:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
        mean = y.mean()
        model = Boosted(float(np.log(mean / (1 - mean))))
        raw = np.full(len(y), model.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-raw))
            g, h = y - p, p * (1 - p)
            which, cut = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, np.inf)
            node = np.zeros(len(y), np.int64)
            for level in range(DEPTH):
                first, width = 2**level - 1, 2**level
                best = np.full(width, 1e-6)
                split = np.full(width, BINS)
                for f in range(x.shape[1]):
                    key = (node - first) * BINS + binned[:, f]
                    tables = [np.bincount(key, v, width * BINS).reshape(width, BINS).cumsum(axis=1) for v in (g, h, np.ones(len(y)))]
                    (gl, gt), (hl, ht), (nl, nt) = ((t, t[:, -1:]) for t in tables)
                    gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                    gain[(nl < LEAF) | (nt - nl < LEAF)] = 0
                    at = gain.argmax(axis=1)
                    top = gain[np.arange(width), at]
                    better = top > best
                    best[better], split[better], which[first : first + width][better] = top[better], at[better], f
                for i in range(width):
                    c = cuts[which[first + i]]
                    cut[first + i] = c[split[i]] if split[i] < len(c) else np.inf
                node = 2 * node + 1 + (x[np.arange(len(y)), which[node]] > cut[node])
            at = node - (2**DEPTH - 1)
            leaf = RATE * np.bincount(at, g, 2**DEPTH) / (np.bincount(at, h, 2**DEPTH) + 1)
            model.trees.append((which, cut, leaf))
            raw += leaf[at]
        return model


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing step fit of y on raw (pool adjacent violators)."""
    levels, at = np.unique(raw, return_inverse=True)  # equal scores are one level, whatever their labels' order
    blocks: list[list[float]] = []
    for r, v, n in zip(levels.tolist(), np.bincount(at, y).tolist(), np.bincount(at).tolist(), strict=True):
        blocks.append([v, n, r, r])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2], last[3]]
    xs = [v for b in blocks for v in (b[2], b[3])]
    ys = [v for b in blocks for v in [(b[0] + 0.02) / (b[1] + 0.04)] * 2]
    return np.array(xs), np.array(ys)


@dataclass
class Model:
    weights: dict[str, float]
    trees: Boosted | None
    knots: tuple[np.ndarray, np.ndarray] | None
    mean: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.mean)
        raw = self.trees.raw(x)
        # a share of the uncalibrated order keeps scores of one step apart
        return 0.98 * np.interp(raw, *self.knots) + 0.02 / (1 + np.exp(-raw))


def in_training():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from labels (doc_id, toxic) whose crc32(doc_id) mod 5 is not 0, at most SAMPLE of them."""
    known = labels.where(in_training() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("_y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    own = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    sample = own.join(F.broadcast(known), F.col("id") == F.col("doc_id")).groupBy("id", "_y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text"))
    sample = staged(sample.select("text", F.col("_y").cast("int").alias("y"), (F.pmod(F.xxhash64("id", F.lit("calibration")), F.lit(4)) == 0).alias("held")), "toxicity-sample")
    ids = known.agg(F.count("*").alias("n"), F.avg("_y").alias("m")).head()
    if not ids.n:
        return Model({}, None, None, 0.0)
    if not 0 < ids.m < 1:
        return Model({}, None, None, float(ids.m))

    def terms(batches):
        for x in pieces(batches, 0, 8 << 20):
            seen = (Counter(), Counter())
            docs_of = [0, 0]
            for t, y in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True):
                own = {w.lower() for w in WORD.findall(t or "")}
                own |= {w[:k] + "~" for w in own for k in (5, 6) if len(w) >= k}
                seen[y > 0].update(own)
                docs_of[y > 0] += 1
            every = [*seen[0].keys() | seen[1].keys()]
            yield pa.RecordBatch.from_arrays([pa.array(["", *every], pa.string()), pa.array([docs_of[1], *(seen[1][k] for k in every)], pa.int64()), pa.array([docs_of[0], *(seen[0][k] for k in every)], pa.int64())], names=["term", "t", "c"])

    counted = sample.where("not held").select("text", "y").mapInArrow(terms, "term string, t long, c long").groupBy("term").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    telling = counted.where((F.col("t") >= LEAST_SUPPORT) & ((F.col("t") > F.col("c") * 0.05) | (F.col("term") == "")))
    ranked = telling.orderBy(F.col("term") != "", F.desc(F.col("t") / (F.col("c") + 1)), "term").limit(LEXICON_POOL).collect()
    total = next(((r.t, r.c) for r in ranked if not r.term), (0, 0))
    weights = learned_weights([(r.term, r.t, r.c) for r in ranked if r.term], *total)
    weights = {w: 2.0 for w in INSULTS} | weights

    def measure(batches):
        lexicon = Lexicon(weights)
        for x in pieces(batches, 0):
            f = features([t or "" for t in x.column(0).to_pylist()], lexicon)
            yield pa.RecordBatch.from_arrays([pa.array(list(f), pa.list_(pa.float64())), x.column(1), x.column(2)], names=["f", "y", "held"])

    table = sample.mapInArrow(measure, "f array<double>, y int, held boolean").toArrow()
    dropped(sample)
    if not table.num_rows:
        return Model({}, None, None, 0.0)
    x = np.array(table.column("f").to_pylist())
    y = (np.array(table.column("y").to_pylist()) > 0).astype(float)
    held = np.array(table.column("held").to_pylist(), bool)
    order = np.lexsort((*x.T, y))  # the same rows in the same order, whatever the tasks' order was
    x, y, held = x[order], y[order], held[order]
    if held.all() or not held.any() or not (0 < y[~held].mean() < 1 and 0 < y[held].mean() < 1):
        return Model(weights, None, None, float(y.mean()))
    trees = Boosted.fit(x[~held], y[~held])
    return Model(weights, trees, isotonic(trees.raw(x[held]), y[held]), float(y.mean()))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from 0.5)."""
    df = docs.drop("score", "predicted")
    at = df.columns.index(text_col)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        lexicon = Lexicon(held.value.weights)
        for x in pieces(batches, at):
            s = np.clip(held.value.scores(features([t or "" for t in x.column(at).to_pylist()], lexicon)), 0, 1)
            yield pa.RecordBatch.from_arrays([*x.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*x.schema.names, "score", "predicted"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = score(docs.select("doc_id", "text"), fit(docs, labels))
    return out.select("doc_id", (~in_training()).alias("held_out"), "score", "predicted")


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that aren't predicted toxic."""
    columns = docs.columns
    return score(docs, fit(docs, labels)).where("predicted = 0").select(*columns)
