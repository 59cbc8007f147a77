"""Phrase collocation mining: phrases of two to four words that stand together more often than their parts tell.

Texts (A-Z lower-cased) are split into pieces at punctuation and line breaks; identical pieces of a language become one row
with a multiplicity. N-grams are then counted, each weighted by its piece's multiplicity: different ones of a slice are summed up where
they are read, dealt into hash buckets by Spark's shuffle, and each bucket is counted by a duckdb of ``MEMORY`` that works out of core, its
spill in a temporary folder of the task's own that goes with the task.

A phrase can only be frequent if all its parts are, so counting goes up in steps, and no step loses anything:

1. words, by their texts: exact counts, and the number of all words;
2. pairs of frequent words, by 40 bits of a hash beside their bucket, 6 bytes each: what several pairs share is counted together, so this can
   only let too many through;
3. triples and quadruples whose pairs all may be frequent, likewise;
4. what has passed, by its text: exact counts. Here infrequent ones go.

Bit maps of fixed size (32 MB at most) carry what passed to the next step; full ones only let more through.

Frequent phrases then ask for the counts of their parts by *lookup requests*: one row for each part of each cut, shuffled to where the
part's count is; parts that many phrases ask for are dealt into parts (``join_hot``). A phrase's longest parts
are frequent themselves, so every request is answered.

Defined cases: a null text is empty, a null language is ``und``; words are what lies between blanks and tabs, so they may
hold any sign that doesn't split; a document's id is not read, repeated rows count each; texts of any length are read whole; ties
go as the order says, to the last place; a language without a frequent phrase, or an empty table, gives no rows; columns other
than ``text`` and ``lang``, whatever their names, are ignored.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bit_map, discard, in_map, join_hot, materialize, text_slices
from .words import byte_set, cut, joined, numbered, pairs, seed_mix

LEAST, LONGEST, TOP, ABSORBED = 30, 4, 2000, 80
SLICE, BUCKET_BYTES, MOST_BUCKETS, MEMORY = 4 << 20, 32 << 20, 16_384, "256MB"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAKS = r"[.,;:!?\n\x0B\f\r]"
GAP = byte_set(0x20, 0x09)
HASH_BYTES = 5
#: Hash buckets in one task: several, so that tasks get alike; rows of packed hashes that duckdb gets at once.
BUCKETS_A_TASK, ROWS_AT_ONCE = 4, 256


def pieces(docs: DataFrame) -> DataFrame:
    """``lang, piece, times``: different pieces with a word, without blanks around them."""
    text = F.translate(F.coalesce(F.col("text"), F.lit("")), UPPER, LOWER)
    every = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.explode(F.split(text, BREAKS)).alias("piece"))
    trimmed = every.select("lang", F.btrim("piece", F.lit(" \t")).alias("piece")).where("piece <> ''")
    return trimmed.groupBy("lang", "piece").agg(F.count(F.lit(1)).alias("times"))


# -- n-grams of a slice --------------------------------------------------------------------------------


class Slice:
    """Words of a batch of pieces: ``word`` numbers the different (language, word) pairs in the order they come."""

    def __init__(self, part: pa.RecordBatch):
        data, bounds = joined(part.column("piece"))
        strings, first = cut(data, bounds, ~GAP[data])
        ids, self.texts = numbered(strings)
        lang, self.langs = pd.factorize(part.column("lang").to_numpy(zero_copy_only=False))
        row = np.repeat(np.arange(part.num_rows), np.diff(first))
        self.row, self.lang = row, lang[row]
        self.times = part.column("times").to_numpy().astype(np.float64)[row]
        self.word, self.n = pairs(ids, self.lang, max(1, len(self.langs)))
        at = firsts(self.word, self.n)
        self.text_of = ids[at]
        spelled = pd.util.hash_array(self.texts.to_numpy(zero_copy_only=False).astype(object), categorize=False) if len(self.texts) else np.zeros(0, np.uint64)
        named = pd.util.hash_array(np.array(self.langs, object), categorize=False) if len(self.langs) else np.zeros(0, np.uint64)
        self.hash = seed_mix(spelled[self.text_of] ^ seed_mix(named[self.lang[at]]))

    def pairs_at(self, known: np.ndarray) -> np.ndarray:
        """First words of pairs that lie in one piece and are both ``known``."""
        both = known[self.word]
        return np.flatnonzero((self.row[1:] == self.row[:-1]) & both[1:] & both[:-1]) if len(self.word) > 1 else np.zeros(0, np.int64)

    def counted(self, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the k-grams that begin at ``at`` the different ones: where each begins first, and its weight (exact below 2^53)."""
        codes, n = self.word[at], self.n
        for i in range(1, k):
            codes, n = pairs(codes, self.word[at + i], self.n)
        return at[firsts(codes, n)], np.bincount(codes, self.times[at], n).astype(np.int64)

    def hashes(self, at: np.ndarray, k: int) -> np.ndarray:
        h = self.hash[self.word[at]]
        for i in range(1, k):
            h = seed_mix(h * np.uint64(0x9E3779B97F4A7C15) + self.hash[self.word[at + i]])
        return h

    def phrases(self, at: np.ndarray, k: int, weight: np.ndarray) -> pa.RecordBatch:
        words = [self.texts.take(pa.array(self.text_of[self.word[at + i]])) for i in range(k)]
        text = pa.compute.binary_join_element_wise(*words, pa.scalar(" ", words[0].type)) if k > 1 else words[0]
        langs = pa.array(np.array(self.langs, object)[self.lang[at]], pa.string())
        return pa.record_batch([langs, text.cast(pa.string()), pa.array(weight)], ["lang", "phrase", "w"])


def firsts(codes: np.ndarray, n: int) -> np.ndarray:
    """Where each code from 0 to n - 1 comes first."""
    out = np.zeros(n, np.int64)
    out[codes[::-1]] = np.arange(len(codes))[::-1]
    return out


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[Slice]:
    for batch in batches:
        for part in text_slices(batch, "piece", SLICE):
            yield Slice(part)


# -- counting in buckets -------------------------------------------------------------------------------


class Bucket:
    """A duckdb that sums weights up out of core; a task has one."""

    def __init__(self, columns: str):
        self.folder = tempfile.TemporaryDirectory(prefix="riskloom-count-")
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": self.folder.name, "preserve_insertion_order": False})
        self.db.execute(f"CREATE TABLE seen ({columns})")

    def add(self, rows: pa.Table) -> None:
        self.db.register("rows", rows)
        self.db.execute("INSERT INTO seen SELECT * FROM rows")
        self.db.unregister("rows")

    def found(self, query: str) -> Iterator[pa.RecordBatch]:
        yield from self.db.sql(query).to_arrow_reader(50_000)

    def close(self) -> None:
        self.db.close()
        self.folder.cleanup()


def count_phrases(rows: DataFrame, buckets: int, least: int) -> DataFrame:
    """``lang, phrase, f`` of the phrases counted ``least`` times or more; each bucket's rest is one row a language without a phrase."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = Bucket("lang VARCHAR, phrase VARCHAR, w BIGINT")
        try:
            for batch in batches:
                bucket.add(pa.Table.from_batches([batch]))
            yield from (
                b.cast(pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())]))
                for b in bucket.found(
                    "WITH t AS (SELECT lang, phrase, CAST(sum(w) AS BIGINT) AS f FROM seen GROUP BY lang, phrase) "
                    f"SELECT lang, CASE WHEN f >= {least} THEN phrase END AS phrase, CAST(sum(f) AS BIGINT) AS f FROM t GROUP BY 1, 2"
                )
            )
        finally:
            bucket.close()

    return rows.repartition(buckets, "lang", "phrase").mapInArrow(count, "lang string, phrase string, f long")


def packed(h: np.ndarray, w: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """A row for each bucket: five bytes of every hash, a byte of every weight, and weights of 255 or more in full."""
    if not len(h):
        return
    bucket = (h >> np.uint64(8 * HASH_BYTES)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    bucket, h, w = bucket[order].astype(np.int64), h[order], w[order]
    starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    low = np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES])
    small = np.minimum(w, 255).astype(np.uint8)
    rows = {"bucket": [], "hashes": [], "weights": [], "large": []}
    for a, b in zip(starts, np.append(starts[1:], len(h)), strict=True):
        rows["bucket"].append(int(bucket[a]))
        rows["hashes"].append(low[a:b].tobytes())
        rows["weights"].append(small[a:b].tobytes())
        rows["large"].append(w[a:b][w[a:b] >= 255].astype("<i8").tobytes())
    yield pa.record_batch([pa.array(rows["bucket"], pa.int32()), *(pa.array(rows[c], pa.binary()) for c in ("hashes", "weights", "large"))], list(rows))


def unpacked(rows: pa.RecordBatch) -> pa.Table:
    """``h, w``: all hashes, their bucket in front, and their weights."""
    low, at = joined(rows.column("hashes"))
    wide = np.zeros((len(low) // HASH_BYTES, 8), np.uint8)
    wide[:, :HASH_BYTES] = low.reshape(-1, HASH_BYTES)
    bucket = np.repeat(rows.column("bucket").to_numpy().astype(np.uint64), np.diff(at) // HASH_BYTES)
    w = joined(rows.column("weights"))[0].astype(np.int64)
    w[w == 255] = joined(rows.column("large"))[0].view("<i8")
    return pa.table({"h": wide.view("<u8").ravel() | (bucket << np.uint64(8 * HASH_BYTES)), "w": w})


def code(bucket: np.ndarray, low: np.ndarray) -> np.ndarray:
    """What a counted hash is known by afterwards: all of it mixed, as a bit map wants."""
    return seed_mix((bucket.astype(np.uint64) << np.uint64(8 * HASH_BYTES)) | low)


def frequent_codes(rows: DataFrame, buckets: int, least: int) -> DataFrame:
    """``v``: codes of the hashes counted ``least`` times or more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = Bucket("h UBIGINT, w BIGINT")
        try:
            for batch in batches:
                for i in range(0, batch.num_rows, ROWS_AT_ONCE):
                    counted.add(unpacked(batch.slice(i, ROWS_AT_ONCE)))
            for found in counted.found(f"SELECT h FROM seen GROUP BY h HAVING sum(w) >= {least}"):
                h = found.column("h").to_numpy()
                yield pa.record_batch([pa.array(seed_mix(h).view(np.int64))], ["v"])
        finally:
            counted.close()

    return rows.repartition(max(1, buckets // BUCKETS_A_TASK), "bucket").mapInArrow(count, "v long")


def passing(sent, h: np.ndarray, buckets: int) -> np.ndarray:
    """Which n-grams of these hashes may be frequent."""
    low = h & np.uint64((1 << (8 * HASH_BYTES)) - 1)
    return in_map(sent.value, code((h >> np.uint64(8 * HASH_BYTES)) % np.uint64(buckets), low))


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, f`` of all phrases of up to ``longest`` words counted ``least`` times or more, and ``lang, n``."""
    spark = docs.sparkSession
    every = materialize(pieces(docs), "pieces")
    size = every.agg(F.sum(F.octet_length("piece")).alias("s")).first()["s"] or 0
    tasks = min(MOST_BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES)))
    buckets = tasks * BUCKETS_A_TASK
    phrase = "lang string, phrase string, w long"
    hashed = "bucket int, hashes binary, weights binary, large binary"

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _slices(batches):
            at, w = s.counted(np.arange(len(s.word)), 1)
            yield s.phrases(at, 1, w)

    single = materialize(count_phrases(every.mapInArrow(words, phrase), tasks, least), "words")
    totals = single.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = single.where("phrase is not null")

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                spelled = pd.util.hash_array(batch.column("phrase").to_numpy(zero_copy_only=False).astype(object), categorize=False)
                langs = pd.util.hash_array(batch.column("lang").to_numpy(zero_copy_only=False).astype(object), categorize=False)
                yield pa.record_batch([pa.array(seed_mix(spelled ^ seed_mix(langs)).view(np.int64))], ["v"])

    known = bit_map(frequent.select("lang", "phrase").mapInArrow(named, "v long"))

    def two(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _slices(batches):
            at, w = s.counted(s.pairs_at(in_map(known.value, s.hash)), 2)
            yield from packed(s.hashes(at, 2), w, buckets)

    often = materialize(frequent_codes(every.mapInArrow(two, hashed), buckets, least), "pairs")
    pair_map = bit_map(often)

    def chained(s: Slice) -> dict[int, np.ndarray]:
        """Beginnings of the n-grams of each length all of whose pairs may be frequent."""
        at = s.pairs_at(in_map(known.value, s.hash))
        good = np.zeros(len(s.word) + 1, bool)
        good[at[passing(pair_map, s.hashes(at, 2), buckets)]] = True
        out = {2: np.flatnonzero(good)}
        for k in range(3, longest + 1):
            out[k] = out[k - 1][good[np.minimum(out[k - 1] + k - 2, len(s.word))]]
        return out

    def more(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _slices(batches):
            found = [(k, *s.counted(at, k)) for k, at in chained(s).items() if k > 2]
            yield from packed(np.concatenate([s.hashes(first, k) for k, first, _ in found]), np.concatenate([w for _, _, w in found]), buckets)

    longer = materialize(frequent_codes(every.mapInArrow(more, hashed), buckets, least), "longer")
    long_map = bit_map(longer)

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _slices(batches):
            for k, at in chained(s).items():
                if k > 2:
                    at = at[passing(long_map, s.hashes(at, k), buckets)]
                first, w = s.counted(at, k)
                yield s.phrases(first, k, w)

    exact = count_phrases(every.mapInArrow(passed, phrase), tasks, least).where("phrase is not null")
    out = materialize(exact.union(frequent), "phrases")
    totals = materialize(totals, "totals")
    for made in (every, often, longer, single):
        discard(made)
    return out, totals


# -- scores --------------------------------------------------------------------------------------------


def _exact(column: Column) -> Column:
    return column.cast("decimal(20,0)")


def scored(frequent: DataFrame) -> DataFrame:
    """``lang, phrase, k, a, l, r, score`` of the phrases of two words or more, by their lowest-scoring cut."""
    split = F.split("phrase", " ")
    candidates = frequent.select("lang", "phrase", F.col("f").alias("a"), split.alias("w"), F.size(split).alias("k")).where("k > 1")
    # Part 2j of cut j is its first j words, part 2j + 1 the others.
    cut_parts = F.expr("flatten(transform(sequence(1, k - 1), j -> array(named_struct('at', 2 * j, 'part', array_join(slice(w, 1, j), ' ')), named_struct('at', 2 * j + 1, 'part', array_join(slice(w, j + 1, k - j), ' ')))))")
    requests = candidates.select("lang", "phrase", "a", "k", F.explode(cut_parts).alias("q")).select("lang", "phrase", "a", "k", "q.*")
    asked = requests.groupBy("lang", "part").agg(F.count(F.lit(1)).alias("asked"))
    answers = materialize(asked.join(frequent.withColumnRenamed("phrase", "part"), ["lang", "part"]), "answers")
    met = join_hot(requests, answers, ["lang", "part"], "asked", F.xxhash64("phrase"))
    # At most six parts a phrase.
    whole = met.groupBy("lang", "phrase", "a", "k").agg(F.map_from_entries(F.collect_list(F.struct("at", "f"))).alias("f"))
    # Whole decimals: products of counts may pass 64 bits, and ``div`` cuts without rounding.
    wide = "cast({} as decimal(20,0))".format
    share = f"(2000000BD * {wide('a')}) div ({wide('f[2 * j]')} + {wide('f[2 * j + 1]')})"
    lowest = f"array_min(transform(sequence(1, k - 1), j -> named_struct('score', {share}, 'j', j, 'l', f[2 * j], 'r', f[2 * j + 1])))"
    best = whole.select("lang", "phrase", "k", "a", F.expr(lowest).alias("c"))
    return best.select("lang", "phrase", "k", "a", "c.l", "c.r", "c.score")


def unabsorbed(found: DataFrame, absorbed: int = ABSORBED) -> DataFrame:
    """Without phrases that lie in a longer one counted ``absorbed`` percent as often or more."""
    inner = F.expr("flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), i -> array_join(slice(w, i, m), ' '))))")
    longer = found.where("k > 2").select("lang", "k", "a", F.split("phrase", " ").alias("w")).select("lang", "a", F.explode(inner).alias("phrase"))
    top = longer.groupBy("lang", "phrase").agg(F.max("a").alias("top"))
    met = found.join(top, ["lang", "phrase"], "left")
    return met.where(F.col("top").isNull() | (_exact(F.col("top")) * 100 < _exact(F.col("a")) * absorbed)).drop("top")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, longest: int = LONGEST) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``top`` phrases."""
    frequent, totals = frequent_phrases(docs.select("text", "lang"), least, longest)
    left = unabsorbed(materialize(scored(frequent), "scored"))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # The first of a language are among the first of its parts, so no task ranks a whole language.
    salt = F.pmod(F.xxhash64("phrase"), F.lit(64))
    some = left.withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    first = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return first.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
