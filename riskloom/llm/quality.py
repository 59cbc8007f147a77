"""Quality rules: counts of a text's own words and lines, and n-gram perplexity within language-specific bands.

The language model is modified Kneser-Ney over the UTF-8 bytes of words (A-Z lower-cased), with a mark before and after each, of order 5.
Spark counts the n-grams of every whole text (summed up in each slice and task, then by n-gram), and derives continuation counts,
discounts and interpolated probabilities by joins from order to order. A text is never scored by a model that has counted it: texts go
into two halves by their hash, copies together, and each half is scored by the model of the other. A model that has learned symbol-ridden
texts finds nothing odd in them, so it doesn't learn from texts with over ``MOST_SYMBOLS`` symbols for 100 words, unless over half of what
its language's half consists of is such (they are usual there). Every text is counted, scored and counts for the bands.

The model is sorted arrays of 64-bit hashes of (language, half, n-gram) with a probability or a back-off weight each, broadcast
in shards of some ``shard_entries`` (4 M, 48 MB) by the last two bytes of the context, so that all a symbol asks for
is in one shard; n-grams of up to two bytes are in every shard. One shard is one pass over the texts. Of more,
each is a pass of its own with a sum for each different text, and the sums are added up.

A language's bands come from the log-perplexities of all its texts that pass the counts: the quartiles, and ``width`` interquartile
ranges beyond either. A short text's figure spreads more, so the bands are wider by ``noise`` / sqrt(symbols). Texts outside
are rejected.

Defined cases: a null or empty text has no words, so it fails the counts; a null language is ``und``; a language whose other half has
no text gives no perplexity, and such texts are kept if they pass the counts; null ids and repeated rows come out each; texts of any length are read whole; an
empty table gives an empty result; columns other than ``doc_id``, ``text`` and ``lang``, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import join_hot, materialize, text_slices
from .words import byte_set, cut, joined, lines, numbered, pairs, seed_mix

ORDER, SHARD_ENTRIES, SLICE = 5, 4_000_000, 1 << 20
#: A model doesn't learn from texts with more symbols than this for 100 words.
MOST_SYMBOLS = 10
#: Repetition and length: fixed values of the base rules.
LEAST_WORDS, MOST_REPEATED, REPEAT = 10, 20, 5
#: Bands: interquartile ranges beyond the quartiles, and what a text of one symbol adds to them.
WIDTH, NOISE = 10.0, 16.0
BLANK = byte_set(0x20, *range(9, 14))
SYMBOL = byte_set(*b"#*$%&|<>")
MARK = 32
#: Bits of an n-gram of bytes, above which its length and its group are packed.
TOP = 8 * ORDER
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)])
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


# -- counts of a text ----------------------------------------------------------------------------------


class Slice:
    """Words and counts of the texts of one batch."""

    def __init__(self, texts: pa.Array):
        self.data, self.bounds = joined(texts)
        self.n = len(texts)
        self.inside = ~BLANK[self.data]
        self.words, first = cut(self.data, self.bounds, self.inside)
        self.n_words = np.diff(first)
        self.row = np.repeat(np.arange(self.n), self.n_words)

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(flags))
        return total[self.bounds[1:]] - total[self.bounds[:-1]]

    def repeated_words(self) -> np.ndarray:
        """Words of each text that lie in a window of five found twice or more in it."""
        ids, different = numbered(self.words)
        v, last = len(different), len(ids) - REPEAT + 1
        if last <= 0:
            return np.zeros(self.n, np.int64)
        w = np.flatnonzero(self.row[REPEAT - 1 :] == self.row[:last])
        # Windows whose hash is alone in their text can't be found twice; the others are compared word by word.
        h = self.row[w].astype(np.uint64)
        for i in range(REPEAT):
            h = h * np.uint64(0x9E3779B97F4A7C15) + ids[w + i].astype(np.uint64) + np.uint64(1)
            h ^= h >> np.uint64(29)
        code = pd.factorize(h)[0]
        w = w[np.bincount(code)[code] >= 2]
        if not len(w):
            return np.zeros(self.n, np.int64)
        window, n = self.row[w], self.n
        for i in range(REPEAT):
            window, n = pairs(window, ids[w + i], v)
        again = w[np.bincount(window, minlength=n)[window] >= 2]
        covered = np.zeros(len(ids) + REPEAT, np.int32)
        np.add.at(covered, again, 1)
        np.add.at(covered, again + REPEAT, -1)
        return np.bincount(self.row[np.cumsum(covered)[: len(ids)] > 0], minlength=self.n)

    def repeated_lines(self) -> np.ndarray:
        """Lines with a word that equal an earlier line of their text."""
        texts, row, starts, ends = lines(self.data, self.bounds)
        held = np.append(0, np.cumsum(self.inside))
        real = np.flatnonzero(held[ends] > held[starts])
        ids, found = numbered(texts.take(pa.array(real)))
        rows = row[real]
        different = np.unique(rows * max(1, len(found)) + ids) // max(1, len(found))
        return np.bincount(rows, minlength=self.n) - np.bincount(different, minlength=self.n)

    def base(self) -> list[np.ndarray]:
        points = self.inside & ((self.data & 0xC0) != 0x80)
        return [
            self.n_words, self.per_text(points), self.per_text(SYMBOL[self.data]), self.repeated_lines(), self.repeated_words(),
        ]


class Grams:
    """Of every symbol of every word the n-gram of ``ORDER``, or from the word's beginning, that ends there."""

    def __init__(self, s: Slice, group: np.ndarray):
        """``group``: a number for each text, from 0."""
        ends = np.frombuffer(s.words.buffers()[1], np.int64)[: len(s.words) + 1]
        sizes = np.diff(ends) + 1  # with the mark after it
        c = np.full(int(sizes.sum()) + 1, MARK, np.int64)
        word = np.repeat(np.arange(len(sizes)), sizes)
        letters = np.ones(len(word), bool)
        letters[np.cumsum(sizes) - 1] = False
        c[1:][letters] = LOWER[s.data[s.inside]]
        since = np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes)  # place in the word
        self.length = np.minimum(since + 2, ORDER)
        packed = c[1:].copy()
        for i in range(1, ORDER):
            packed[i - 1 :] |= c[: len(c) - i] << (8 * i)
        packed &= (1 << (8 * self.length)) - 1
        #: The text of each symbol, and the number of its (group, n-gram) among the different ones.
        self.row = s.row[word]
        self.ids, keys = pd.factorize(packed | (self.length << TOP) | (group[self.row] << (TOP + 3)))
        self.group, self.k, self.gram = keys >> (TOP + 3), (keys >> TOP) & 7, keys & ((1 << TOP) - 1)


def keyed(gram: np.ndarray, seed: np.ndarray, k: np.ndarray | int) -> np.ndarray:
    """The hash that a model's arrays are sorted by."""
    return seed_mix(gram.astype(np.uint64) ^ seed_mix(seed.astype(np.uint64) + np.asarray(k).astype(np.uint64)))


# -- counting and the model ----------------------------------------------------------------------------


def _language(docs: DataFrame) -> Column:
    return F.coalesce(F.col("lang").cast("string"), F.lit("und"))


def _half(text: Column) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(2)).cast("int")


def count_grams(docs: DataFrame) -> DataFrame:
    """``lang, half, k, gram, c, plain``: the n-grams of all texts, how often each was seen, and how often in texts with few symbols."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text", SLICE):
                langs, halves = part.column("lang"), part.column("half").to_numpy()
                number, named = numbered(langs)
                s = Slice(part.column("text"))
                g = Grams(s, number * 2 + halves)
                plain = 100 * s.per_text(SYMBOL[s.data]) <= MOST_SYMBOLS * s.n_words
                yield pa.record_batch(
                    [
                        named.take(pa.array(g.group >> 1)).cast(pa.string()), pa.array((g.group & 1).astype(np.int32)), pa.array(g.k.astype(np.int32)),
                        pa.array(g.gram), pa.array(np.bincount(g.ids, minlength=len(g.gram))),
                        pa.array(np.bincount(g.ids[plain[g.row]], minlength=len(g.gram))),
                    ],
                    ["lang", "half", "k", "gram", "c", "plain"],
                )

    texts = docs.where("text is not null").select(_language(docs).alias("lang"), _half(F.col("text")).alias("half"), "text")
    seen = texts.mapInArrow(count, "lang string, half int, k int, gram long, c long, plain long")
    return seen.groupBy("lang", "half", "k", "gram").agg(F.sum("c").alias("c"), F.sum("plain").alias("plain"))


GROUP = ["lang", "half"]


def learned(counts: DataFrame) -> DataFrame:
    """``lang, half, k, gram, c``: what a model learns from."""
    usual = materialize(counts.groupBy(*GROUP).agg((2 * F.sum("plain") >= F.sum("c")).alias("usual"), F.count(F.lit(1)).alias("n")), "usual")
    c = F.when(F.col("usual"), F.col("plain")).otherwise(F.col("c")).alias("c")
    return join_hot(counts, usual, GROUP, "n", F.xxhash64("gram")).select(*GROUP, "k", "gram", c).where("c > 0")


def continuations(counts: DataFrame) -> DataFrame:
    """``lang, half, k, gram, c`` of all orders: a shorter n-gram counts in how many different symbols' wake it was seen, one from a
    word's beginning how often."""
    level = out = counts.where(F.col("k") == ORDER)
    for k in range(ORDER - 1, 0, -1):
        rest = F.col("gram").bitwiseAND(F.lit((1 << (8 * k)) - 1)).alias("gram")
        follows = level.groupBy(*GROUP, F.lit(k).alias("k"), rest).agg(F.count(F.lit(1)).alias("c"))
        level = materialize(counts.where(F.col("k") == k).union(follows), "grams")
        out = out.union(level)
    return out


def probabilities(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Interpolated modified Kneser-Ney: ``lang, half, k, gram, p`` of every n-gram seen (of length 0: a symbol never seen),
    and ``lang, half, k, gram, w`` of every context."""
    every = materialize(continuations(counts), "grams")
    n = {j: F.count_if(F.col("c") == j).cast("double").alias(f"n{j}") for j in (1, 2, 3, 4)}
    found = every.groupBy(*GROUP, "k").agg(*n.values(), F.count(F.lit(1)).alias("n"))
    share = F.expr("n1 / nullif(n1 + 2 * n2, 0)")

    def discount(j: int) -> Column:
        usual = j - (j + 1) * share * F.col(f"n{j + 1}") / F.expr(f"nullif(n{j}, 0)")
        return F.least(F.lit(float(j)), F.greatest(F.lit(0.05), F.coalesce(usual, F.lit(0.5 * j)))).alias(f"d{j}")

    discounts = materialize(found.select(*GROUP, "k", "n", *[discount(j) for j in (1, 2, 3)]), "discounts")
    off = F.expr("CASE WHEN c = 1 THEN d1 WHEN c = 2 THEN d2 ELSE d3 END")
    rows = join_hot(every, discounts, [*GROUP, "k"], "n", F.xxhash64("gram")).withColumns({"off": off, "context": F.expr("shiftright(gram, 8)")})
    rows = materialize(rows.select(*GROUP, "k", "gram", "context", "c", "off"), "grams")
    contexts = rows.groupBy(*GROUP, "k", "context").agg(F.sum("c").alias("total"), (F.sum("off") / F.sum("c")).alias("w"), F.count(F.lit(1)).alias("kinds"))
    contexts = materialize(contexts, "contexts")
    own = rows.join(contexts, [*GROUP, "k", "context"]).withColumn("own", (F.col("c") - F.col("off")) / F.col("total"))
    own = materialize(own.select(*GROUP, "k", "gram", "own", "w", "kinds"), "grams")
    lower = own.where("k = 1").select(*GROUP, "k", "gram", (F.col("own") + F.col("w") / (F.col("kinds") + 1)).alias("p"))
    unseen = contexts.where("k = 1").select(*GROUP, F.lit(0).alias("k"), F.lit(0).cast("long").alias("gram"), (F.col("w") / (F.col("kinds") + 1)).alias("p"))
    out = lower.union(unseen)
    for k in range(2, ORDER + 1):
        below = lower.select(*GROUP, F.col("gram").alias("rest"), F.col("p").alias("q"))
        mine = own.where(F.col("k") == k).withColumn("rest", F.col("gram").bitwiseAND(F.lit((1 << (8 * (k - 1))) - 1)))
        lower = materialize(mine.join(below, [*GROUP, "rest"]).select(*GROUP, "k", "gram", (F.col("own") + F.col("w") * F.col("q")).alias("p")), "grams")
        out = out.union(lower)
    return out, contexts.where("k > 1").select(*GROUP, (F.col("k") - 1).alias("k"), F.col("context").alias("gram"), "w")


def _shard(last_two: Column | np.ndarray) -> Column | np.ndarray:
    """What deals contexts into shards by their last two symbols."""
    return last_two * 2_654_435_761 % 65_521


def hashed(entries: DataFrame, value: str, after: int) -> DataFrame:
    """``k, h, deal, v``: an entry's hash, what its context is dealt by (``after`` symbols follow that), its value's logarithm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gram, seed, k = (batch.column(c).to_numpy() for c in ("gram", "seed", "k"))
            yield pa.record_batch([batch.column("k"), pa.array(keyed(gram, seed, k).view(np.int64)), batch.column("deal"), batch.column("v")], ["k", "h", "deal", "v"])

    last_two = F.shiftright("gram", 8 * after).bitwiseAND(F.lit(0xFFFF))
    rows = entries.select("k", "gram", F.xxhash64("lang", "half").alias("seed"), _shard(last_two).alias("deal"), F.log(value).cast("float").alias("v"))
    return rows.mapInArrow(run, "k int, h long, deal long, v float")


class Table:
    """Sorted hashes and their values."""

    def __init__(self, found: pa.Table):
        h = found.column("h").to_numpy().view(np.uint64)
        order = np.argsort(h, kind="stable")
        self.h, self.v = h[order], found.column("v").to_numpy()[order].astype(np.float32)

    def look(self, keys: np.ndarray) -> np.ndarray:
        """Values, NaN where there is none."""
        if not len(self.h):
            return np.full(len(keys), np.nan)
        at = np.minimum(np.searchsorted(self.h, keys), len(self.h) - 1)
        return np.where(self.h[at] == keys, self.v[at], np.nan)


def log_probabilities(g: Grams, seeds: np.ndarray, grams: Table, contexts: Table, shard: int, shards: int) -> np.ndarray:
    """The natural logarithm of each symbol's probability, 0 where another shard has it, NaN where there is no model."""
    seed = seeds[g.group]
    deal = np.where(g.k >= 3, _shard((g.gram >> 8) & 0xFFFF) % shards, 0)
    out = np.zeros(len(g.gram))
    ask = deal == shard
    for k in range(ORDER, 0, -1):
        now = np.flatnonzero(ask & (g.k >= k))
        gram = g.gram[now] & ((1 << (8 * k)) - 1)
        v = grams.look(keyed(gram, seed[now], k))
        seen = ~np.isnan(v)
        out[now[seen]] += v[seen]
        ask[now[seen]] = False
        if k > 1:
            rest = now[~seen]
            w = contexts.look(keyed(gram[~seen] >> 8, seed[rest], k - 1))
            out[rest] += np.where(np.isnan(w), 0, w)
    left = np.flatnonzero(ask)
    out[left] += grams.look(keyed(np.zeros(len(left), np.int64), seed[left], 0))
    return out[g.ids]


def score(docs: DataFrame, keep: list[str], shard_entries: int = SHARD_ENTRIES) -> DataFrame:
    """The columns in ``keep``, ``lang``, the base counts, ``symbols`` and ``nats`` (the text's negative log-likelihood, null without a model)."""
    spark = docs.sparkSession
    grams, contexts = probabilities(materialize(learned(materialize(count_grams(docs), "grams")), "grams"))
    grams, contexts = materialize(hashed(grams, "p", 1), "model-grams"), materialize(hashed(contexts, "w", 0), "model-contexts")
    shards = max(1, -(-(grams.count() + contexts.count()) // shard_entries))
    text = F.coalesce(F.col("text"), F.lit(""))
    seed = F.xxhash64(_language(docs), 1 - _half(text))
    key = F.struct(seed.alias("s"), F.xxhash64(text).alias("a"), F.xxhash64(F.lit(7), text).alias("b"))
    ready = docs.select(F.struct(*[F.col(c) for c in keep]).alias("_row"), _language(docs).alias("lang"), text.alias("text"), seed.alias("seed"), key.alias("key"))

    def passed(shard: int, base: bool) -> DataFrame:
        # At most shard_entries numbers of 12 bytes, and what every shard has: n-grams of one and two symbols.
        mine = [Table(t.where(f"k <= {most} or deal % {shards} = {shard}").select("h", "v").toArrow()) for t, most in ((grams, 2), (contexts, 1))]
        sent = spark.sparkContext.broadcast(mine)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in text_slices(batch, "text", SLICE):
                    s = Slice(part.column("text"))
                    groups, seeds = pd.factorize(part.column("seed").to_numpy())
                    g = Grams(s, groups)
                    nats = -np.bincount(g.row, log_probabilities(g, seeds, *sent.value, shard, shards), s.n).astype(float)  # of nothing it counts in integers
                    score = [pa.array(np.bincount(g.row, minlength=s.n)), pa.array(nats, mask=np.isnan(nats))]
                    if base:
                        yield pa.record_batch([*(part.column(c) for c in ("_row", "lang", "key")), *(pa.array(c.astype(np.int64)) for c in s.base()), *score], [*names, "symbols", "nats"])
                    else:
                        yield pa.record_batch([part.column("key"), score[1]], ["key", "nats"])

        row = f"_row {ready.schema['_row'].dataType.simpleString()}, lang string, key {ready.schema['key'].dataType.simpleString()}"
        names = ["_row", "lang", "key", *(c.split()[0] for c in BASE.split(", "))]
        if base:
            return ready.mapInArrow(run, f"{row}, {BASE}, symbols long, nats double")
        return ready.select("text", "seed", "key").mapInArrow(run, f"key {ready.schema['key'].dataType.simpleString()}, nats double")

    first = materialize(passed(0, True), "scored")
    if shards > 1:
        sums = None
        for shard in range(1, shards):
            # Equal texts have equal sums: one row for each different text.
            one = materialize(passed(shard, False).groupBy("key").agg(F.max("nats").alias("more"), F.count(F.lit(1)).alias("n")), "shard")
            sums = one if sums is None else sums.union(one)
        more = materialize(sums.groupBy("key").agg(F.sum("more").alias("more"), F.count("more").alias("known"), F.max("n").alias("n")), "shards")
        first = join_hot(first, more, ["key"], "n", F.xxhash64(F.monotonically_increasing_id()))
        first = first.withColumn("nats", F.when(F.col("known") == shards - 1, F.col("nats") + F.col("more")))
    return first.select("_row.*", "lang", *[c.split()[0] for c in BASE.split(", ")], "symbols", "nats")


# -- bands and verdicts --------------------------------------------------------------------------------


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def bands(scored: DataFrame, width: float = WIDTH) -> DataFrame:
    """``lang, lower, upper``: log-perplexity bands from the quartiles over all texts that pass the counts, to a thousandth."""
    figure = scored.where(~F.col("base_failed") & F.col("log_perplexity").isNotNull())
    steps = figure.groupBy("lang", F.round(F.col("log_perplexity") * 1000).cast("long").alias("at")).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("lang")  # a row for each thousandth at most
    so_far = steps.withColumns({"up_to": F.sum("n").over(whole.orderBy("at")), "all": F.sum("n").over(whole)})
    quartile = {q: F.min(F.when(F.col("up_to") * 4 >= F.col("all") * q, F.col("at"))) / 1000 for q in (1, 3)}
    found = so_far.groupBy("lang").agg(quartile[1].alias("q1"), quartile[3].alias("q3"))
    reach = width * (F.col("q3") - F.col("q1"))
    return found.select("lang", (F.col("q1") - reach).alias("lower"), (F.col("q3") + reach).alias("upper"))


def quality(docs: DataFrame, width: float = WIDTH, noise: float = NOISE, shard_entries: int = SHARD_ENTRIES) -> DataFrame:
    """Per document row: ``doc_id, lang``, the base counts, ``base_failed``, ``perplexity``, its bands and ``kept``."""
    scored = score(docs.select("doc_id", "text", "lang"), ["doc_id"], shard_entries)
    scored = scored.withColumns({"base_failed": base_failed(), "log_perplexity": F.expr("nats / nullif(symbols, 0)")})
    scored = materialize(scored, "judged")
    weights = scored.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    limits = materialize(weights.join(bands(scored, width), "lang", "left"), "bands")
    met = join_hot(scored, limits, ["lang"], "n", F.xxhash64(F.monotonically_increasing_id()))
    slack = F.lit(noise) / F.sqrt(F.greatest(F.col("symbols"), F.lit(1)))
    lower, upper = F.col("lower") - slack, F.col("upper") + slack
    inside = F.coalesce(F.col("log_perplexity").between(lower, upper), F.lit(True))
    return met.select(
        "doc_id", "lang", *[c.split()[0] for c in BASE.split(", ")], "base_failed", F.exp("log_perplexity").alias("perplexity"),
        F.exp(lower).alias("lower"), F.exp(upper).alias("upper"), (~F.col("base_failed") & inside).alias("kept"),
    )
