"""Substring dedup: paragraph MinHash banding, exact verification, removals clustered by components.

Words are runs of ASCII letters and digits (lower-cased) and non-ASCII characters. Two kinds of
paragraph are compared:

* *lines*, and *blocks* of several lines between blank lines, of at least ``least`` (5) words: MinHash over their five-word shingles, in bands tuned for recall
  at Jaccard 0.8 (10 bands of 4: 99.5 %), colliding ones verified by exact Jaccard. Shorter lines
  repeat where they are equal;
* *passages*, for text repeated inside longer lines or across them: windows of ``window`` (16) words whose
  hash is least among ``near`` (36) neighbours. Any run of ``window + near - 1`` (51) words that two
  documents share has such a window in common. A window that repeats is a seed: its holder of least id is the
  reference, and every other holder is followed word by word to both ends of what it shares with that one.
  Where both go on alike up to the next chosen window a hash of the words between says so; only where they
  part are the words beside the window compared, and holders that part from the reference at the same word
  are looked up among each other, so a run is followed to its ends whichever two documents share it. (Of several
  places in one document where a passage goes on alike the first is followed; the others show the passage itself.)

Equal paragraphs collapse before they are banded: all that leaves a task of a line's copies is one row a
band. What turned out to repeat is then looked up in the rest; a bit map of 64 bits for each value, up to
32 MB, first drops the rows that can't be among it, so few shuffle twice. (A full map drops none, and loses
none.) Shingle sets are made in a second reading, for one holder of each line that collided, and never
shuffle for the others. A band's bucket never emits its pairs: all members are compared with its least line,
and only those unlike it meet the whole bucket, in tiles of bounded size that return a spanning forest of
their links; buckets with the same members are solved once. Lines, spans and seeds that a large share of all
rows hold are dealt into parts when joined. Components give each paragraph its class, and a class that occurs
in two documents or more is a repeat: it stays in the document with the least id and is a removal in the others.

Result: a row per document, component and maximal span, ``doc_id, component_id`` (the document that
keeps the text), ``start_char, end_char`` (code points), ``removed``. Documents without a repeat have none.

Defined cases: null and empty texts, and lines without a word, have no paragraphs;
repeated rows of one ``doc_id`` are one document, and what repeats within one only is no repeat; null ids take
no part; texts of any length are read whole; ties go to the lesser id and the earlier place; an empty table
gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bit_map, discard_all, in_map, join_hot, materialize, maybe_in, release, scratch, text_slices
from .components import components

SHINGLE, LEAST, WINDOW, NEAR, JACCARD, BANDS, ROWS, TILE = 5, 5, 16, 36, 0.8, 10, 4, 1024
#: Shingles that a tile side holds at most, but for a single line of more.
TILE_SHINGLES = 1 << 20
PASSAGE, SHORT, LINE = 0, 1, 2
U = np.uint64
#: Bytes to word characters: A-Z become a-z, 0 is no word character.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], np.uint8)
_RNG = np.random.default_rng(20240229)
ODD = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
TOP = U(0xFFFFFFFFFFFFFFFF)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64 bits (the splitmix finaliser)."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


class Words:
    """Words of several texts at once: hash, byte span, line and text number of each."""

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        low = LOWER[raw]
        at = np.flatnonzero(low)
        lengths = np.array([len(t) + 1 for t in texts])
        self.begin = np.concatenate([[0], np.cumsum(lengths)])
        if not len(at):
            self.hash = np.zeros(0, U)
            self.start = self.end = self.text = self.line = self.block = np.zeros(0, np.int64)
            self.chars = np.zeros(len(raw) + 1, np.int64)
            return
        fresh = np.concatenate([[True], np.diff(at) > 1])
        first = np.flatnonzero(fresh)
        self.start = at[first]
        self.end = at[np.concatenate([first[1:], [len(at)]]) - 1] + 1
        place = at - np.repeat(self.start, np.diff(np.concatenate([first, [len(at)]])))
        powers = np.multiply.accumulate(np.full(int(place.max()) + 1, 0x9E3779B97F4A7C15, U))
        self.hash = mix(np.add.reduceat((low[at].astype(U) + U(1)) * powers[place], first))
        self.line = np.cumsum(raw == 10, dtype=np.int64)[self.start]
        # A line end whose line holds nothing but blanks ends a block, as the end of a text does.
        ends = np.flatnonzero(raw == 10)
        solid = np.cumsum(~np.isin(raw, (9, 10, 11, 12, 13, 32)), dtype=np.int64)[ends]
        void = np.diff(solid, prepend=0) == 0
        void[np.searchsorted(ends, self.begin[1:] - 1)] = True
        self.block = np.concatenate([[0], np.cumsum(void)])[self.line]
        self.text = np.searchsorted(self.begin, self.start, "right") - 1
        self.chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])

    def char(self, byte: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Code-point offsets inside their texts of byte positions."""
        return self.chars[byte] - self.chars[self.begin[text]]

    def shingles(self, k: int) -> np.ndarray:
        """Hash of the k words from each position; the last k - 1 positions are left out."""
        n = max(0, len(self.hash) - k + 1)
        out = np.zeros(n, U)
        for j in range(k):
            out += self.hash[j : j + n] * ODD[j]
        return mix(out)


def _sliding(values: np.ndarray, n: int, pick: np.ufunc) -> np.ndarray:
    """Least or largest of each n neighbours."""
    out, span = values, 1
    while span * 2 <= n:
        out, span = pick(out[:-span], out[span:]), span * 2
    size = len(values) - n + 1
    return out[:size] if span == n else pick(out[:size], out[n - span : n - span + size])


def passages(w: Words, k: int, near: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions and two hashes of the windows of k words that are least among ``near`` neighbours."""
    n = len(w.hash) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, U)
    s = w.shingles(SHINGLE)
    offsets = sorted({*range(0, k - SHINGLE, SHINGLE), k - SHINGLE})
    one, two = np.zeros(n, U), np.zeros(n, U)
    for j, o in enumerate(offsets):
        one += s[o : o + n] * ODD[100 + j]
        two += s[o : o + n] * ODD[150 + j]
    one = mix(one)
    one[w.text[:n] != w.text[k - 1 :]] = TOP
    # Texts lie one after another with k - 1 void windows between: no neighbourhood may reach over, so each
    # text's windows are laid out ``near`` apart from the next text's.
    owner = w.text[:n]
    place = np.arange(n) + near * (owner - owner[0])
    padded = np.full(int(place[-1]) + 2 * near, TOP, U)
    padded[place + near - 1] = one
    least = _sliding(padded, near, np.minimum)
    chosen = one == _sliding(least, near, np.maximum)[place]  # some run of ``near`` neighbours has its least here
    at = np.flatnonzero(chosen & (one != TOP))
    return at, mix(one[at] ^ ODD[241]), mix(two[at])  # least hashes are small ones; scrambled, they spread


class Phrases:
    """Hashes of any run of words, from prefix sums: equal runs have equal hashes wherever they lie."""

    def __init__(self, w: Words):
        base = int(ODD[230]) | 5
        power = np.multiply.accumulate(np.concatenate([[U(1)], np.full(len(w.hash), base, U)]))
        self.inverse = np.multiply.accumulate(np.concatenate([[U(1)], np.full(len(w.hash), pow(base, -1, 1 << 64), U)]))
        self.sums = np.concatenate([[U(0)], np.cumsum(w.hash * power[:-1], dtype=U)])

    def hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.sums[b] - self.sums[a]) * self.inverse[a] + (b - a).astype(U) * ODD[232])


def neighbours(w: Words, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each chosen passage the word after its next one and the first word of its last one (or the text's ends),
    and a hash of the words from here to there."""
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none.astype(U), none.astype(U)
    text = w.text[at]
    begin, stop = np.searchsorted(w.text, text, "left"), np.searchsorted(w.text, text, "right")
    follows = np.concatenate([text[1:] == text[:-1], [False]])
    led = np.concatenate([[False], follows[:-1]])
    to = np.where(follows, np.concatenate([at[1:], [0]]) + window, stop)
    back = np.where(led, np.concatenate([[0], at[:-1]]), begin)
    p = Phrases(w)
    return to, back, p.hash(at, to) ^ (~follows * ODD[242]), p.hash(back, at + window) ^ (~led * ODD[242])


def _units(number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and word after the last of the runs of words of one number."""
    if not len(number):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.flatnonzero(np.diff(number)) + 1
    return np.concatenate([[0], cut]), np.concatenate([cut, [len(number)]])


def lines(w: Words, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The lines with at least ``least`` words, then the blocks of several such or shorter lines between blank lines."""
    a, b = _units(w.line)
    c, d = _units(w.block)
    several = w.line[c] != w.line[d - 1]
    a, b = np.concatenate([a, c[several]]), np.concatenate([b, d[several]])
    long = b - a >= max(least, SHINGLE)
    return a[long], b[long]


def short_lines(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines of too few words for a shingle, with two hashes: they are compared whole."""
    a, b = _units(w.line)
    a, b = a[b - a < SHINGLE], b[b - a < SHINGLE]
    one, two = np.zeros(len(a), U), np.zeros(len(a), U)
    for j in range(SHINGLE - 1):
        has = a + j < b
        one[has] += w.hash[a[has] + j] * ODD[244 + j]
        two[has] += w.hash[a[has] + j] * ODD[248 + j]
    return a, b, mix(one + ODD[252]), mix(two)


def _ranges(values: np.ndarray, a: np.ndarray, b: np.ndarray, pick: np.ufunc) -> np.ndarray:
    """``pick`` over each range [a, b) of ``values``, none of them empty."""
    ends = np.stack([a, b], 1).ravel()
    return pick.reduceat(np.append(values, values[:1]), ends)[::2]


def _line_hashes(w: Words, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines and blocks with two hashes of the words in order, and the shingles at all places."""
    a, b = lines(w, least)
    s = w.shingles(SHINGLE)
    if not len(a):
        return a, b, np.zeros(0, U), np.zeros(0, U), s
    p = Phrases(w)
    return a, b, p.hash(a, b), p.hash(a, b) ^ _ranges(mix(s + ODD[200]), a, b - SHINGLE + 1, np.bitwise_xor), s


def _band_keys(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Band keys of the shingle ranges [a, b). A 64-bit scramble of a shingle serves two 32-bit hash functions."""
    keys = np.zeros((len(a), BANDS), U)
    for k in range(0, BANDS * ROWS, 2):
        m = mix(s * ODD[k] + ODD[k + 50])
        for j, half in ((k, (m >> U(32)).astype(np.uint32)), (k + 1, m.astype(np.uint32))):
            keys[:, j // ROWS] = keys[:, j // ROWS] * ODD[201] + _ranges(half, a, b, np.minimum) + U(1)
    return mix(keys + np.arange(BANDS, dtype=np.uint64) * ODD[202])


def _shingle_sets(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """The distinct shingles of each range, 32 bits, sorted."""
    small = (s >> U(32)).astype(np.uint32)
    return [np.unique(small[x:y]) for x, y in zip(a, b, strict=True)]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")


def _paragraphs(docs: DataFrame, least: int, window: int, near: int, sets: bool = True) -> DataFrame:
    """``doc_id, kind, line, start_char, end_char, h1, h2, bands, shingles`` (without ``sets`` null; bands and shingles are
    lines' alone), and for passages ``to_char, back_char``, the far ends of the next and last one, with hashes ``right, left``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text", 1 << 20):
                ids = np.asarray(part.column("doc_id").to_numpy(zero_copy_only=False))
                w = Words(part.column("text").cast(pa.large_binary()).to_pylist())
                at, p1, p2 = passages(w, window, near)
                to, back, right, left = neighbours(w, at, window)
                c, d, s1, s2 = short_lines(w)
                a, b, l1, l2, s = _line_hashes(w, least)
                keys = _band_keys(s, a, b - SHINGLE + 1) if len(a) else np.zeros((0, BANDS), U)
                made = _shingle_sets(s, a, b - SHINGLE + 1) if sets else []
                first, last = np.concatenate([at, c, a]), np.concatenate([at + window, d, b]) - 1
                text, n = w.text[first], len(at)
                line = np.arange(len(first)) >= n + len(c)
                kind = np.repeat(np.array([PASSAGE, SHORT, LINE], np.int8), [n, len(c), len(a)])
                void = np.arange(len(first)) >= n

                def beside(values: np.ndarray, void=void, n=n, size=len(first)) -> pa.Array:
                    return pa.array(np.concatenate([values, np.zeros(size - n, values.dtype)]).astype(np.int32), mask=void)

                yield pa.record_batch(
                    [
                        pa.array(ids[text]),
                        pa.array(kind),
                        pa.array(kind == LINE),
                        pa.array(w.char(w.start[first], text).astype(np.int32)),
                        pa.array(w.char(w.end[last], text).astype(np.int32)),
                        pa.array(np.concatenate([p1, s1, l1]).view(np.int64)),
                        pa.array((np.concatenate([p2, s2, l2]) >> U(32)).astype(np.uint32).view(np.int32)),
                        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(line * BANDS)]).astype(np.int32)), pa.array(keys.view(np.int64).ravel()), mask=pa.array(~line)),
                        pa.array([None] * (n + len(c)) + [x.view(np.int32) for x in made], pa.list_(pa.int32())) if sets else pa.nulls(len(first), pa.list_(pa.int32())),
                        beside(w.char(w.end[to - 1], text[:n])),
                        beside(w.char(w.start[back], text[:n])),
                        beside((right >> U(32)).astype(np.uint32).view(np.int32)),
                        beside((left >> U(32)).astype(np.uint32).view(np.int32)),
                    ],
                    ["doc_id", "kind", "line", "start_char", "end_char", "h1", "h2", "bands", "shingles", "to_char", "back_char", "right", "left"],
                )

    return _texts(docs).mapInArrow(
        run,
        "doc_id long, kind byte, line boolean, start_char int, end_char int, h1 long, h2 int, bands array<long>, shingles array<int>, "
        "to_char int, back_char int, right int, left int",
    )


def _holders(docs: DataFrame, wanted: DataFrame, key: str):
    """Documents that may hold a (``doc_id``, hash ``key``) of ``wanted``, with ``_at`` (a hash of the id), and the bit map of the pairs."""
    pairs = bit_map(wanted.select(F.col(key).bitwiseXOR(F.xxhash64("doc_id"))))
    texts = _texts(docs).withColumn("_at", F.xxhash64("doc_id"))
    return maybe_in(texts, "_at", wanted.select(F.xxhash64("doc_id"))), pairs


def _at_hash(part: pa.RecordBatch) -> np.ndarray:
    return part.column("_at").to_numpy(zero_copy_only=False).astype(np.int64).view(U)


def _sets_of(docs: DataFrame, wanted: DataFrame, least: int) -> DataFrame:
    """``h1, shingles`` of the lines ``doc_id, h1`` of ``wanted`` (and of few others), each once."""
    texts, pairs = _holders(docs, wanted, "h1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text", 1 << 20):
                w = Words(part.column("text").cast(pa.large_binary()).to_pylist())
                a, b, one, _, s = _line_hashes(w, least)
                got = in_map(pairs.value, one ^ _at_hash(part)[w.text[a]])
                sets = _shingle_sets(s, a[got], b[got] - SHINGLE + 1)
                yield pa.record_batch(
                    [pa.array(one[got].view(np.int64)), pa.array([x.view(np.int32) for x in sets], pa.list_(pa.int32()))], ["h1", "shingles"]
                )

    return texts.mapInArrow(run, "h1 long, shingles array<int>").dropDuplicates(["h1"])


def _sides(docs: DataFrame, wanted: DataFrame, window: int, near: int) -> DataFrame:
    """The words beside the passages of ``wanted`` (``doc_id, key``): ``doc_id, h1, rightward, start_char, words`` (hashes of the
    ``near`` next, outwards), ``reach`` (where each of them ends, or starts)."""
    texts, pairs = _holders(docs, wanted, "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text", 1 << 20):
                ids = np.asarray(part.column("doc_id").to_numpy(zero_copy_only=False))
                w = Words(part.column("text").cast(pa.large_binary()).to_pylist())
                at, one, _ = passages(w, window, near)
                _, _, *ways = neighbours(w, at, window)
                small = (w.hash >> U(32)).astype(np.uint32).view(np.int32)
                own = _at_hash(part)[w.text[at]]
                for side, way in zip((True, False), ways, strict=True):
                    way = (way >> U(32)) << U(16)
                    got = np.flatnonzero(in_map(pairs.value, one ^ own ^ way ^ (RIGHT if side else U(0))))
                    if not len(got):
                        continue
                    # Of the places in a text where a passage goes on alike, the first.
                    _, first = np.unique(np.stack([w.text[at[got]].astype(U), one[got], way[got]], 1), axis=0, return_index=True)
                    got = got[np.sort(first)]
                    here, h = at[got], one[got]
                    text = w.text[here]
                    first = here + window if side else np.maximum(here - near, np.searchsorted(w.text, text, "left"))
                    last = np.minimum(here + window + near, np.searchsorted(w.text, text, "right")) if side else here
                    spans = [np.arange(x, y) if side else np.arange(y - 1, x - 1, -1) for x, y in zip(first, last, strict=True)]
                    size = np.array([len(x) for x in spans])
                    every = np.concatenate(spans).astype(np.int64)
                    ends = w.char((w.end if side else w.start)[every], np.repeat(text, size)).astype(np.int32)
                    cut = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
                    yield pa.record_batch(
                        [
                            pa.array(ids[text]), pa.array(h.view(np.int64)), pa.array(np.full(len(here), side)),
                            pa.array(w.char(w.start[here], text).astype(np.int32)),
                            pa.ListArray.from_arrays(cut, pa.array(small[every])), pa.ListArray.from_arrays(cut, pa.array(ends)),
                        ],
                        ["doc_id", "h1", "rightward", "start_char", "words", "reach"],
                    )

    return texts.mapInArrow(run, "doc_id long, h1 long, rightward boolean, start_char int, words array<int>, reach array<int>").distinct()


#: Tells the right side of a passage from its left side in a bit map.
RIGHT = ODD[240]


def _runs(docs: DataFrame, seeds: DataFrame, window: int, near: int) -> DataFrame:
    """Repeated runs round the repeated passages ``seeds``: ``doc_id, component_id, start_char, end_char``, with repeats.

    ``seeds`` has ``component_id``, the least holder, and ``n``, the number of rows of each passage.
    """
    key = ["h1", "h2"]
    where = F.struct("start_char", "end_char", "to_char", "back_char", "right", "left")
    least = seeds.where("doc_id = component_id").groupBy(*key).agg(F.min(where).alias("ref"), F.max("n").alias("weight"))
    met = join_hot(seeds.where("doc_id != component_id"), least, key, "weight", F.xxhash64("doc_id"))
    met = materialize(met, "met-seeds")

    def span(doc: Column, a: Column, b: Column) -> Column:
        return F.struct(doc.alias("doc_id"), F.col("component_id"), a.alias("start_char"), b.alias("end_char"))

    own, kept = F.col("doc_id"), F.col("component_id")
    alike_right, alike_left = F.col("right") == F.col("ref.right"), F.col("left") == F.col("ref.left")
    whole = F.explode(
        F.array(
            span(own, F.when(alike_left, F.col("back_char")).otherwise(F.col("start_char")), F.when(alike_right, F.col("to_char")).otherwise(F.col("end_char"))),
            span(kept, F.when(alike_left, F.col("ref.back_char")).otherwise(F.col("ref.start_char")), F.when(alike_right, F.col("ref.to_char")).otherwise(F.col("ref.end_char"))),
        )
    )
    again = seeds.where("doc_id = component_id").select("doc_id", "component_id", "start_char", "end_char")
    spans = met.select(whole.alias("s")).select("s.*").union(again).distinct()
    # Where a holder and the reference part before their next chosen window, the words beside this one tell where.
    side = [*key, "rightward"]
    row = ["doc_id", "component_id", *key, "start_char", "end_char", "ref", "weight"]

    def sided(right: Column, left: Column) -> DataFrame:
        """Holders by side; of a document's places where the passage goes on alike (``way``) the first."""
        each = met.select(*row, "right", "left", F.explode(F.array_compact(F.array(F.when(right, F.lit(True)), F.when(left, F.lit(False))))).alias("rightward"))
        each = each.withColumn("way", F.when(F.col("rightward"), F.col("right")).otherwise(F.col("left")))
        first = each.groupBy("doc_id", "component_id", *side, "way", "ref").agg(*[F.min(c).alias(c) for c in ("start_char", "end_char")], F.max("weight").alias("weight"))
        return materialize(first, "sides")

    way = F.shiftleft(F.col("way").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)), 16)
    hashed = F.when(F.col("rightward"), F.col("h1").bitwiseXOR(F.lit(int(RIGHT.view(np.int64))))).otherwise(F.col("h1")).bitwiseXOR(way).alias("key")

    def beside(wanted: DataFrame) -> DataFrame:
        return materialize(_sides(docs, materialize(wanted.select("doc_id", hashed).distinct(), "parting"), window, near), "beside")

    def compared(ours: DataFrame) -> DataFrame:
        both = join_hot(ours, theirs, side, "parts", F.xxhash64("doc_id"))
        differs = F.array_position(F.zip_with("words", "ref_words", lambda x, y: F.coalesce(x == y, F.lit(False))), False)
        n = F.when(differs == 0, F.size("words")).otherwise(differs.cast("int") - 1)
        return materialize(both.withColumn("n", n).drop("ref_words", "parts"), "parted")

    part = sided(~alike_right, ~alike_left)
    ref_way = F.when(F.col("rightward"), F.col("ref.right")).otherwise(F.col("ref.left"))
    refs = part.groupBy(*side).agg(F.min("component_id").alias("doc_id"), F.min("ref.start_char").alias("start_char"), F.min(ref_way).alias("way"), F.max("weight").alias("parts"))
    words = beside(part.select("doc_id", *side, "way").union(refs.select("doc_id", *side, "way")))
    theirs = words.join(refs.drop("way"), ["doc_id", "h1", "rightward", "start_char"]).dropDuplicates(side)
    theirs = materialize(theirs.select(*side, "parts", F.col("words").alias("ref_words"), F.col("reach").alias("ref_reach")), "references")
    both = compared(part.join(words, ["doc_id", "h1", "rightward", "start_char"]))
    release(docs.sparkSession)
    every = both
    # One that goes with the reference beyond the next window (there it isn't chosen) may go further with a holder that hasn't parted yet.
    last = F.get("ref_reach", F.col("n") - 1)
    past = both.where((F.col("n") > 0) & F.when(F.col("rightward"), last >= F.col("ref.to_char")).otherwise(last <= F.col("ref.back_char")))
    past = past.groupBy(*side).agg(F.max("weight").alias("parts"))
    if past.take(1):
        others = materialize(join_hot(sided(alike_right, alike_left), past, side, "parts", F.xxhash64("doc_id")).drop("parts"), "others")
        every = both.unionByName(compared(others.join(beside(others), ["doc_id", "h1", "rightward", "start_char"])))
    end, ref_end = F.get("reach", F.col("n") - 1), F.get("ref_reach", F.col("n") - 1)
    longer = F.explode(
        F.array(
            F.when(F.col("rightward"), span(own, F.col("start_char"), end)).otherwise(span(own, end, F.col("end_char"))),
            F.when(F.col("rightward"), span(kept, F.col("ref.start_char"), ref_end)).otherwise(span(kept, ref_end, F.col("ref.end_char"))),
        )
    )
    spans = spans.union(both.where("n > 0").select(longer.alias("s")).select("s.*").distinct())
    return spans.union(_surplus(every))


def _surplus(parted: DataFrame) -> DataFrame:
    """What holders that part from the reference after ``n`` words share with each other beyond: it stays in the least of them."""
    side = ["h1", "h2", "rightward"]
    row = [*side, "doc_id", "start_char", "end_char", "words", "reach", "n"]
    more = parted.where(F.size("words") > F.col("n")).select(*row, F.xxhash64(F.slice("words", F.lit(1), F.col("n") + 1)).alias("ahead"))
    several = more.groupBy(*side, "ahead").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("parts"))
    several = materialize(several.where("first != last").drop("first", "last"), "several")
    on = join_hot(maybe_in(more, "ahead", several.select("ahead")), several, [*side, "ahead"], "parts", F.xxhash64("doc_id")).drop("ahead", "parts")
    # Most go on alike past all the words at hand: those are looked up at that length, only the others at every length.
    full = materialize(on.withColumn("h", F.xxhash64("words")), "full")
    alike = full.groupBy(*side, "h").agg(F.min("doc_id").alias("component_id"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("parts"))
    alike = materialize(alike.where("component_id != last").drop("last"), "alike")
    at_end = F.struct(F.size("words").alias("e"), "component_id", F.element_at("reach", -1).alias("at")).alias("m")
    to_end = join_hot(maybe_in(full, "h", alike.select("h")), alike, [*side, "h"], "parts", F.xxhash64("doc_id"))
    to_end = to_end.select("doc_id", *side, "start_char", "end_char", at_end)
    rest = full.join(alike, [*side, "h"], "left_anti")
    each = rest.select(*row, F.explode(F.sequence(F.col("n") + 1, F.size("words"))).alias("e"))
    each = each.select(*side, "doc_id", "start_char", "end_char", "e", F.xxhash64(F.slice("words", F.lit(1), F.col("e"))).alias("h"), F.get("reach", F.col("e") - 1).alias("at"))
    each = materialize(each, "surplus")
    # The others' prefixes count as well: of each full length, one row of the least and of the last holder stand for all.
    ends = alike.select(*side, "h", "component_id")
    ends = full.select(*side, "h", "n", "words").dropDuplicates([*side, "h"]).join(ends, [*side, "h"])
    ends = ends.select(*side, "component_id", F.explode(F.sequence(F.col("n") + 1, F.size("words"))).alias("e"), "words")
    ends = ends.select(*side, F.xxhash64(F.slice("words", F.lit(1), F.col("e"))).alias("h"), "e", F.col("component_id").alias("doc_id"))
    known = each.select(*side, "h", "e", "doc_id").union(ends)
    held = known.groupBy(*side, "e", "h").agg(F.min("doc_id").alias("component_id"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("parts"))
    held = materialize(held.where("component_id != last").drop("last"), "shared-surplus")
    release(parted.sparkSession)
    met = join_hot(maybe_in(each, "h", held.select("h")), held, [*side, "e", "h"], "parts", F.xxhash64("doc_id"))
    far = met.groupBy("doc_id", *side, "start_char", "end_char").agg(F.max(F.struct("e", "component_id", "at")).alias("m")).union(to_end)
    start = F.when(F.col("rightward"), F.col("start_char")).otherwise(F.col("m.at"))
    stop = F.when(F.col("rightward"), F.col("m.at")).otherwise(F.col("end_char"))
    return far.select("doc_id", "m.component_id", start.alias("start_char"), stop.alias("end_char"))


def forest(ids: np.ndarray, sets: list[np.ndarray], rows: np.ndarray, cols: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links (Jaccard >= ``least``) between members ``rows`` and ``cols``.

    Members are compared with all columns at once; a tile ends early when it has become one class.
    """
    sizes = np.array([len(s) for s in sets])
    values, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    ends = np.cumsum(sizes)
    common = np.add.reduceat(np.bincount(inverse)[inverse], ends - sizes) / sizes
    label = np.arange(len(sets))
    out = []
    in_cols = np.isin(np.arange(len(sets)), cols)
    mark = np.zeros(len(values), bool)
    for i in sorted(rows, key=lambda r: -common[r]):  # the most typical first
        mine = inverse[ends[i] - sizes[i] : ends[i]]
        mark[mine] = True
        shared = np.bincount(owner[mark[inverse]], minlength=len(sets))
        mark[mine] = False
        near = in_cols & (shared >= least * (sizes[i] + sizes - shared))
        labels, first = np.unique(label[near], return_index=True)
        others = labels != label[i]
        if others.any():
            out += [(int(ids[i]), int(ids[x])) for x in np.flatnonzero(near)[first[others]]]
            label[np.isin(label, labels)] = label[i]
            if (label == label[i]).all():
                break
    return out


def line_links(lines: DataFrame, jaccard: float = JACCARD, tile: int = TILE, sets_of: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``h1, bands`` (lines, with repeats) -> edges ``a, b`` whose components are those of all links.

    ``sets_of`` makes ``h1, shingles`` for a column of lines that collided; without it ``lines`` has the shingles.
    """
    banded = lines.select("h1", F.explode("bands").alias("key"))
    small = F.hash("h1")  # is a key's line always the same one? 32 bits say so
    ends = banded.groupBy("key").agg(F.min(small).alias("lo"), F.max(small).alias("hi"))
    shared = materialize(ends.where("lo != hi").select("key"), "bands")
    # Copies of a line leave each task once; so many of them weigh no more than one.
    met = maybe_in(banded, "key", shared).distinct().join(shared, "key")
    met = materialize(met, "members")
    release(lines.sparkSession)
    sizes = met.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("h1")).alias("x"), F.sum(F.xxhash64("h1", F.lit(1)).bitwiseAND(0xFFFFFFFF)).alias("s"), F.min("h1").alias("leader")
    )
    # Bands that gather the same lines are one bucket.
    buckets = sizes.groupBy("n", "x", "s").agg(F.min("key").alias("key"), F.min("leader").alias("leader")).drop("x", "s")
    ids = met.select("h1").distinct()
    sets = sets_of(ids) if sets_of else maybe_in(lines.select("h1", "shingles"), "h1", ids).dropDuplicates(["h1"])
    members = join_hot(met, buckets, ["key"], "n", F.xxhash64("h1")).join(sets, "h1")
    members = materialize(members.select("key", "h1", "leader", "shingles"), "sets")
    held = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("shingles")).alias("m"))
    large = materialize(held.where((F.col("n") > tile) | (F.col("m") > 2 * TILE_SHINGLES)), "large")
    one = members.join(held.where((F.col("n") <= tile) & (F.col("m") <= 2 * TILE_SHINGLES)).select("key"), "key")
    zero = F.lit(0)
    tiles = one.select("key", zero.alias("i"), zero.alias("j"), "h1", F.lit(True).alias("row"), F.lit(True).alias("col"), "shingles")
    star = None
    if large.take(1):
        crowd = materialize(join_hot(members, large, ["key"], "n", F.xxhash64("h1")), "crowd")
        lead = crowd.where("h1 = leader").select("key", "n", F.col("shingles").alias("lead"))
        judged = join_hot(crowd.drop("n", "m"), lead, ["key"], "n", F.xxhash64("h1"))
        common = F.size(F.array_intersect("shingles", "lead"))
        alike = common >= jaccard * (F.size("shingles") + F.size("lead") - common)
        judged = materialize(judged.select("key", "h1", "leader", "shingles", alike.alias("alike")), "judged")
        star = judged.where("alike and h1 != leader").select(F.col("leader").alias("a"), F.col("h1").alias("b"))
        # Those unlike the leader meet the whole bucket: as rows of tiles whose columns are all members.
        odd = judged.where("not alike")
        counts = odd.groupBy("key").agg(F.count(F.lit(1)).alias("r"), F.sum(F.size("shingles")).alias("rm")).join(large, "key")

        def parts(n: str, m: str) -> Column:
            return F.ceil(F.greatest(F.col(n) / tile, F.col(m) / TILE_SHINGLES)).cast("int")

        counts = materialize(counts.select("key", "n", "r", parts("r", "rm").alias("rows"), parts("n", "m").alias("cols")), "counts")
        mark = F.xxhash64("h1", F.lit(2))

        def dealt(df: DataFrame, weight: str, row: bool) -> DataFrame:
            at = join_hot(df.select("key", "h1", "shingles"), counts.select("key", weight, "rows", "cols"), ["key"], weight, F.xxhash64("h1"))
            own, other = ("rows", "cols") if row else ("cols", "rows")
            mine, every = F.pmod(mark, own).cast("int"), F.explode(F.sequence(zero, F.col(other) - 1))
            at = at.withColumns({"mine": mine, "every": every})
            i, j = ("mine", "every") if row else ("every", "mine")
            return at.select("key", F.col(i).alias("i"), F.col(j).alias("j"), "h1", F.lit(row).alias("row"), F.lit(not row).alias("col"), "shingles")

        tiles = tiles.union(dealt(odd, "r", True)).union(dealt(judged, "n", False))
    keys = ["key", "i", "j"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def solve(g: pd.DataFrame, cuts: np.ndarray) -> pd.DataFrame:
            """Edges of the tiles between ``cuts``; the columns are taken apart once for all of them."""
            ids, row, col = g["h1"].to_numpy(), g["row"].to_numpy(bool), g["col"].to_numpy(bool)
            sets = [np.asarray(s, np.int32).view(np.uint32) for s in g["shingles"]]
            edges: list[tuple[int, int]] = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b - a == 2:
                    x, y = sets[a], sets[a + 1]
                    least = jaccard * max(len(x), len(y))  # sets so unlike in size aren't compared
                    if min(len(x), len(y)) >= least and (row[a] and col[a + 1] or row[a + 1] and col[a]):
                        common = len(np.intersect1d(x, y, assume_unique=True))
                        if common >= jaccard * (len(x) + len(y) - common):
                            edges.append((int(ids[a]), int(ids[a + 1])))
                elif b - a > 2:
                    rows, cols = np.flatnonzero(row[a:b]), np.flatnonzero(col[a:b])
                    if len(rows) and len(cols):
                        edges += forest(ids[a:b], sets[a:b], rows, cols, jaccard)
            return pd.DataFrame(edges, columns=["a", "b"], dtype="int64")

        rest = None
        for batch in batches:
            batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            k = batch[keys].to_numpy()
            cuts = np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1
            rest = batch.iloc[cuts[-1] :] if len(cuts) else batch
            if len(cuts):
                yield solve(batch.iloc[: cuts[-1]], np.concatenate([[0], cuts]))
        if rest is not None:
            yield solve(rest, np.array([0, len(rest)]))

    found = tiles.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, "a long, b long")
    return found if star is None else found.union(star)


def _line_classes(docs: DataFrame, spans: DataFrame, least: int, jaccard: float) -> DataFrame:
    """Lines in classes of near copies held by two documents or more: ``h1, component_id, n`` (rows that have them)."""
    lines = spans.where("line")

    def sets_of(ids: DataFrame) -> DataFrame:
        held = maybe_in(lines.select("h1", "doc_id"), "h1", ids).groupBy("h1").agg(F.min("doc_id").alias("doc_id"))
        return materialize(_sets_of(docs, materialize(held, "holders"), least), "shingles")

    with scratch() as made:
        roots = components(line_links(lines.select("h1", "bands"), jaccard, sets_of=sets_of)).withColumnRenamed("node", "h1")
        roots = materialize(roots, "line-roots")
        held = maybe_in(lines.select("h1", "doc_id"), "h1", roots.select("h1"))
        held = held.groupBy("h1").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n")).join(roots, "h1")
        held = materialize(held, "line-holders")
        classes = held.groupBy("root").agg(F.min("first").alias("component_id"), F.max("last").alias("most"), F.count(F.lit(1)).alias("members"))
        alike = join_hot(held, classes.where("component_id != most"), ["root"], "members", F.xxhash64("h1"))
        out = materialize(alike.select("h1", "component_id", "n"), "line-classes")
        discard_all(made, out)
    return out


def repeats(docs: DataFrame, least: int = LEAST, window: int = WINDOW, near: int = NEAR, jaccard: float = JACCARD) -> DataFrame:
    """Spans that repeat across documents: ``doc_id, component_id, start_char, end_char, removed``."""
    with scratch() as made:
        found = materialize(_paragraphs(docs, least, window, near, sets=False).drop("shingles"), "paragraphs")
        # Equal paragraphs: one row each, combined before the shuffle.
        equal = found.groupBy("h1", "h2").agg(F.min("doc_id").alias("component_id"), F.max("doc_id").alias("most"), F.count(F.lit(1)).alias("n"))
        equal = materialize(equal.where("component_id != most").drop("most"), "equal")
        alike = _line_classes(docs, found, least, jaccard)
        release(docs.sparkSession)
        part = ["doc_id", "component_id", "start_char", "end_char"]
        lines = found.where("line").select("doc_id", "start_char", "end_char", "h1")
        near_hits = join_hot(maybe_in(lines, "h1", alike.select("h1")), alike, ["h1"], "n", F.xxhash64("doc_id")).select(part)
        # A line in a class of near copies has that class; other paragraphs have the one of their equals.
        held = join_hot(
            maybe_in(found.drop("bands"), "h1", equal.select("h1")), equal, ["h1", "h2"], "n", F.xxhash64("doc_id")
        )
        held = materialize(held, "held")
        release(docs.sparkSession)
        short = held.where(f"kind = {SHORT}").select(part)
        same = held.where("line").select(*part, "h1").join(alike.select("h1"), "h1", "left_anti").select(part)
        runs = _runs(docs, held.where(f"kind = {PASSAGE}"), window, near)
        hit = near_hits.union(short).union(same).union(runs.select(part)).distinct()
        # Overlapping and touching paragraphs of one component become one span.
        order = Window.partitionBy("doc_id", "component_id").orderBy("start_char", "end_char")
        reach = F.max("end_char").over(order.rowsBetween(Window.unboundedPreceding, -1))
        joined = hit.withColumn("fresh", F.coalesce(F.col("start_char") > reach + 1, F.lit(True)).cast("int"))
        joined = joined.withColumn("run", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        merged = joined.groupBy("doc_id", "component_id", "run").agg(F.min("start_char").alias("start_char"), F.max("end_char").alias("end_char"))
        out = materialize(merged.drop("run"), "spans")
        discard_all(made, out)
    return out.select("doc_id", "component_id", "start_char", "end_char", (F.col("doc_id") != F.col("component_id")).alias("removed"))
