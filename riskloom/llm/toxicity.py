"""Toxicity: gradient-boosted trees over dense text features, calibrated by isotonic regression.

Features come from the text alone: lexicon densities (a fixed list, and one learned from the training
rows), second-person words near lexicon hits, capitals, punctuation and obfuscation rates. Training
uses a bounded sample, at most ``max_train`` labelled rows (those with the least hashes), so the driver
fits a matrix of fixed size; one fold calibrates and takes no part in the trees, nor in the learned lexicon. The trees' own rows
are measured with lexicons learned from nine tenths of them, without their own tenth, so no label shapes a feature of its own row. The fitted model is a
few kilobytes; scoring is one narrow pass over whole texts.

Defined cases: null text is empty text and is scored like any other; a document labelled more than once
is toxic if any label says so; null labels are no labels; without both classes every score is the share
of toxic labels (0 without labels); repeated rows get the same score; of several texts under one labelled id the one of
least hash trains the model, and each is scored by itself; texts of any length are read whole; an empty table of documents
gives an empty result; columns that ``keep`` doesn't name are left out, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import materialize, only, text_slices

MAX_TRAIN, MAX_LEARNED, CALIBRATION_FOLD = 20_000, 400, 4
#: Parts of the training rows; each is measured with a lexicon learned from the others.
PARTS = 10

#: Insults in English, French, German and Spanish.
LEXICON = frozenset(
    """
    ass asshole bastard bitch bullshit clown coward crap creep cretin damn degenerate dickhead dimwit disgusting
    dumb dumbass dummy filth filthy fool freak fuck fucker fucking garbage halfwit hate hideous idiot idiotic
    imbecile jerk kill liar loser lowlife lunatic maggot moron moronic nasty parasite pathetic pig prick psycho
    rat repulsive retard rotten rubbish scum scumbag shit shitty shut sick sleazy slut stupid sucker sucks swine
    trash trashy troll twat ugly useless vermin vile whore wimp worthless wretch
    abruti batard connard connasse cretine debile degage encule imbecile merde minable moche nul ordure pourri
    pute racaille salaud salope stupide vaurien
    abschaum arsch arschloch blodmann dreck dreckig dumm dummkopf ekelhaft hurensohn idioten luegner mist
    mull nutzlos scheisse schlampe schwein trottel verlierer versager widerlich
    asco asqueroso basura bobo cabron estupido gilipollas imbecil inutil malnacido mierda pendejo perdedor puta
    tonto zorra
    """.split()
)
#: Second-person words in the same languages.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer ti tus usted ustedes vosotros".split()
)
#: Signs read as letters.
LEET = bytes.maketrans(b"0134578@$!|+", b"oieastbasiit")
BLANKS = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
UPPER, DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SPACED = re.compile(rb"(?<![0-9a-z\x80-\xff])(?:[a-z0-9@$!][ .*_-]){2,24}[a-z0-9@$!](?![0-9a-z\x80-\xff])")
#: Words with signs or digits in them; bounds and the look-behind keep it linear on any text.
SIGNED = re.compile(rb"(?<![a-z0-9@$!|+*])[a-z]{0,24}[0-9@$!|+*][a-z0-9@$!|+*]{0,24}")
NEAR = 6
NAMES = (
    "log_words mean_word fixed_hits fixed_rate learned_hits learned_rate worst_50 near_you near_rate you_rate "
    "upper_rate caps_words exclaim_rate question_rate mark_rate digit_rate hidden_hits hidden_rate spaced_hits "
    "repeat_letters top_share learned_kinds"
).split()


def words_of(low: bytes) -> list[bytes]:
    return low.translate(BLANKS).split()


def features(text: bytes | None, learned: frozenset[bytes], fixed: frozenset[bytes]) -> list[float]:
    text = text or b""
    low = text.lower()
    words = words_of(low)
    n, size = max(1, len(words)), max(1, len(text))
    at = [i for i, w in enumerate(words) if w in fixed or w in learned]
    hits_fixed = sum(words[i] in fixed for i in at)
    learned_at = [words[i] for i in at if words[i] in learned]
    you = np.array([i for i, w in enumerate(words) if w in YOU])
    near, worst = 0, 0
    if at:
        where = np.array(at)
        worst = int((np.searchsorted(where, where + 50) - np.arange(len(where))).max())
        if len(you):
            near = int((np.searchsorted(you, where + NEAR, "right") > np.searchsorted(you, where - NEAR)).sum())
    hidden = sum(
        plain in fixed or plain in learned
        for w in SIGNED.findall(low)
        if (plain := w.translate(LEET, b"*")) != w and plain.strip(b"i") != b""
    )
    spaced = sum(
        (plain := s.translate(LEET, b" .*_-")) in fixed or plain in learned for s in SPACED.findall(low)
    )
    upper = len(text) - len(text.translate(None, UPPER))
    marks = len(text) - len(text.translate(None, MARKS))
    return [
        np.log1p(len(words)), size / n, np.log1p(hits_fixed), hits_fixed / n, np.log1p(len(learned_at)), len(learned_at) / n,
        worst, np.log1p(near), near / n, len(you) / n, upper / size, sum(1 for w in text.split() if len(w) > 2 and w.isupper()) / n,
        text.count(b"!") / n, text.count(b"?") / n, marks / size, (len(text) - len(text.translate(None, DIGITS))) / size,
        np.log1p(hidden), hidden / n, np.log1p(spaced), sum(low.count(c * 3) for c in (b"a", b"e", b"i", b"o", b"u")) / n,
        (max(map(learned_at.count, set(learned_at))) / n) if learned_at else 0.0, len(set(learned_at)),
    ]


YOU = frozenset(w.encode() for w in SECOND_PERSON)
FIXED = frozenset(w.encode() for w in LEXICON)


@dataclass
class Trees:
    """Boosted regression trees for the logistic loss, split on quantile bins; plain arrays throughout."""

    rounds: int = 80
    depth: int = 3
    rate: float = 0.15
    bins: int = 48
    least: int = 8
    l2: float = 1.0
    prior: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        share = min(max(y.mean(), 1e-6), 1 - 1e-6)
        self.prior = float(np.log(share / (1 - share)))
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        codes = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], 1)
        raw = np.full(len(y), self.prior)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-raw))
            g, h = y - p, np.maximum(p * (1 - p), 1e-9)
            n_nodes = 2 ** (self.depth + 1) - 1
            split, cut, value = np.full(n_nodes, -1), np.zeros(n_nodes), np.zeros(n_nodes)
            node = np.zeros(len(y), np.int64)
            for k in range(n_nodes):
                mine = np.flatnonzero(node == k)
                if not len(mine):
                    continue
                gs, hs = g[mine].sum(), h[mine].sum()
                value[k] = self.rate * gs / (hs + self.l2)
                if k >= n_nodes // 2 or len(mine) < 2 * self.least:
                    continue
                best = (1e-6, -1, 0.0)
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    c = codes[mine, f]
                    gl = np.cumsum(np.bincount(c, g[mine], len(e) + 1))[:-1]
                    hl = np.cumsum(np.bincount(c, h[mine], len(e) + 1))[:-1]
                    nl = np.cumsum(np.bincount(c, minlength=len(e) + 1))[:-1]
                    gain = gl**2 / (hl + self.l2) + (gs - gl) ** 2 / (hs - hl + self.l2) - gs**2 / (hs + self.l2)
                    gain[(nl < self.least) | (len(mine) - nl < self.least)] = 0
                    b = int(gain.argmax())
                    if gain[b] > best[0]:
                        best = (float(gain[b]), f, float(e[b]))
                if best[1] >= 0:
                    split[k], cut[k] = best[1], best[2]
                    node[mine] = 2 * k + 1 + (x[mine, best[1]] > best[2])
            self.trees.append((split, cut, value))
            raw = raw + self._one(self.trees[-1], x)
        return self

    @staticmethod
    def _one(tree: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
        split, cut, value = tree
        node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while (inner := split[node] >= 0).any():
            k = node[inner]
            node[inner] = 2 * k + 1 + (x[rows[inner], split[k]] > cut[k])
        return value[node]

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.prior + sum((self._one(t, x) for t in self.trees), np.zeros(len(x)))


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: centres and means of the pooled blocks, both increasing."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []  # weight, sum of y, sum of raw
    for r, t in zip(raw[order], y[order], strict=True):
        blocks.append([1.0, float(t), float(r)])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[2] / b[0] for b in blocks]), np.array([b[1] / b[0] for b in blocks])


@dataclass
class Model:
    learned: frozenset[bytes]
    share: float
    trees: Trees | None = None
    knots: tuple[np.ndarray, np.ndarray] | None = None

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        if self.trees is None or self.knots is None:
            return np.full(len(texts), self.share)
        x = np.array([features(t, self.learned, FIXED) for t in texts], float).reshape(-1, len(NAMES))
        raw = self.trees.raw(x)
        # A trace of the raw score orders what isotonic steps leave equal.
        return np.clip(0.998 * np.interp(raw, *self.knots) + 0.002 / (1 + np.exp(-raw)), 0, 1)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo five; fold 0 is held out."""
    return F.pmod(F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")), F.lit(5))


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_learned: int = MAX_LEARNED) -> Model:
    """Fit on at most ``max_train`` labelled documents outside fold 0."""
    votes = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = votes.where(fold(F.col("doc_id")) != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    # At most max_train rows of two numbers, so this side has a fixed bound.
    picked = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    # Of several texts under one id the one of least hash counts, in whatever order the rows come.
    one = picked.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), F.col("text").alias("text"))).alias("t"), F.max("toxic").alias("toxic"))
    rows = materialize(one.select("doc_id", "t.text", "toxic"), "toxic-train")

    def vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("toxicity")
        for batch in batches:
            for piece in text_slices(batch, "text"):
                words, toxic, parts = [], [], []
                for raw, y, p in zip(piece.column("text").cast(pa.large_binary()).to_pylist(), piece.column("toxic").to_pylist(), piece.column("part").to_pylist(), strict=True):
                    new = [w.decode("utf-8", "ignore") for w in set(words_of((raw or b"").lower()))]
                    words += new
                    toxic += [y] * len(new)
                    parts += [p] * len(new)
                yield pa.record_batch([pa.array(words, pa.string()), pa.array(toxic, pa.int32()), pa.array(parts, pa.int32())], ["word", "toxic", "part"])

    share = rows.agg(F.avg("toxic").alias("p"), F.count(F.lit(1)).alias("n")).first()
    if not share["n"] or share["p"] in (0.0, 1.0):
        return Model(frozenset(), float(share["p"] or 0))
    p = share["p"]
    odds = F.log((F.col("bad") + 0.5 * p) / (F.col("good") + 0.5 * (1 - p))) - F.lit(float(np.log(p / (1 - p))))
    part = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(PARTS)).cast("int").alias("part")
    labelled = rows.select("text", F.col("toxic").cast("int").alias("toxic"), fold(F.col("doc_id")).cast("int").alias("fold"), part)
    others = labelled.where(F.col("fold") != CALIBRATION_FOLD)
    teachers = others if others.take(1) else labelled
    counted = teachers.mapInArrow(vocabulary, "word string, toxic int, part int").groupBy("word", "part").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    # All lexicons in one query: number k is learned without part k, number -1 from all; a word has a few numbers for each part.
    seen = counted.groupBy("word").agg(F.sum("bad").alias("all_bad"), F.sum("good").alias("all_good"), F.collect_list(F.struct("part", "bad", "good")).alias("parts"))
    each = seen.where("all_bad >= 3").withColumn("k", F.explode(F.sequence(F.lit(-1), F.lit(PARTS - 1))))
    own = {n: F.expr(f"aggregate(filter(parts, p -> p.part = k), 0L, (n, p) -> n + p.{n})") for n in ("bad", "good")}
    each = each.select("word", "k", *[(F.col(f"all_{n}") - c).alias(n) for n, c in own.items()]).where((F.col("bad") >= 3) & (odds > 2.0))
    best = Window.partitionBy("k").orderBy(F.desc(odds * F.sqrt("bad")), "word")
    lexicons: dict[int, set[bytes]] = {k: set() for k in range(-1, PARTS)}
    for r in each.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= max_learned).select("k", "word").collect():
        lexicons[r["k"]].add(r["word"].encode())
    words = frozenset(lexicons[-1])
    unseen = [frozenset(lexicons[k]) for k in range(PARTS)]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in text_slices(batch, "text"):
                texts, folds, parts = piece.column("text").cast(pa.large_binary()).to_pylist(), piece.column("fold").to_pylist(), piece.column("part").to_pylist()
                x = [features(t, words if f == CALIBRATION_FOLD else unseen[p], FIXED) for t, f, p in zip(texts, folds, parts, strict=True)]
                yield pa.record_batch([piece.column("toxic"), piece.column("fold"), pa.array(x, pa.list_(pa.float64()))], ["toxic", "fold", "x"])

    measured = labelled.mapInArrow(lambda b: measure(b), "toxic int, fold int, x array<double>").collect()  # at most max_train rows of a few numbers
    x = np.array([r["x"] for r in measured])
    y = np.array([r["toxic"] for r in measured], float)
    calibrate = np.array([r["fold"] == CALIBRATION_FOLD for r in measured])
    order = np.lexsort((*x.T, y))  # whatever order the rows came in
    x, y, calibrate = x[order], y[order], calibrate[order]
    if len(set(y[~calibrate])) < 2 or len(set(y[calibrate])) < 2:
        calibrate = np.zeros(len(y), bool)
    trees = Trees().fit(x[~calibrate], y[~calibrate])
    judged = calibrate if calibrate.any() else ~calibrate
    return Model(words, p, trees, isotonic(trees.raw(x[judged]), y[judged]))


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """Adds ``score`` to the columns in ``keep`` (``doc_id``) of every document row."""
    keep = keep or ["doc_id"]
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few kilobytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("toxicity")
        for batch in batches:
            for part in text_slices(batch, "_text"):
                s = sent.value.scores(part.column("_text").cast(pa.large_binary()).to_pylist())
                yield pa.record_batch([*(part.column(c) for c in keep), pa.array(s, pa.float64())], [*keep, "score"])

    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("score", T.DoubleType())])
    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """Per document row: ``doc_id, held_out, score, predicted``."""
    scored = score(docs, train(docs, labels, max_train))
    return scored.select(
        "doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
