"""Benchmark decontamination with one Aho-Corasick automaton over normalised test questions and answers.

Normalising lower-cases A-Z and keeps words of digits, letters and non-ASCII characters. A window is
ten consecutive words of an item; a shorter item is one window. The automaton runs over word numbers
(the benchmark's vocabulary; any other word is 0), so each text is read once, whole, whatever the
number of windows. Hits come back as word positions and are mapped to code-point spans of the original.

The benchmark is the stated query set: it is streamed to the driver in blocks of at most ``block_words`` words (an item of
more is a block of its own), and each block is broadcast as one automaton. Up to 200,000 words, some 180 MB and 8 seconds
to build in a worker, are one block, so the documents are read once and nothing shuffles or is written. Of more
blocks each is a pass of its own whose rows are written to the shared folder, so that a worker never holds two
automata; where workers have more memory, ask for larger blocks.

Defined cases: a null or empty text has no words; an item without words has no window; a null
``item_id`` counts as the empty string; repeated rows are scanned each; an item listed twice counts once; texts of any
length are scanned whole; without items no document is hit, and an empty table of documents gives an empty result;
columns that ``keep`` doesn't name are left out, whatever their names.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialize, only, text_slices

WINDOW, BLOCK_WORDS = 10, 200_000
#: Bytes to words: A-Z become a-z, digits, letters and bytes of non-ASCII characters stay, all else is a blank.
NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
WORD = re.compile("[0-9A-Za-z\u0080-\U0010ffff]+")


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(NORMAL).split()


def windows_of(words: list[bytes], window: int = WINDOW) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    k = min(window, len(words))
    return [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]


class Automaton:
    """Windows of a block of items; built where it is first used and kept by the worker process."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.numbers: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            for w in windows_of(words_of(text), window):
                key = tuple(self.numbers.setdefault(x, len(self.numbers) + 1) for x in w)
                owners.setdefault(key, set()).add(item)
        self.trie = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, who in owners.items():
            self.trie.add_word(key, (len(key), sorted(who)))
        if owners:
            self.trie.make_automaton()
        self.empty = not owners

    @classmethod
    def of(cls, name: str, block, window: int) -> Automaton:
        built = only("automaton")
        if name not in built:
            built.clear()
            built[name] = cls(block.value, window)
        return built[name]

    def hits(self, words: list[bytes]) -> Iterator[tuple[int, int, list[str]]]:
        """(first word, word after the last, items) of every occurrence."""
        if self.empty or not words:
            return
        number = self.numbers.get
        for end, (k, who) in self.trie.iter(tuple([number(w, 0) for w in words])):
            yield end - k + 1, end + 1, who


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def to_text(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word spans as code-point spans of the original text; both are sorted, so one walk does."""
    out, want = [], iter(spans)
    now = next(want, None)
    start = 0
    for k, m in enumerate(WORD.finditer(text)):
        if now is None:
            break
        if k == now[0]:
            start = m.start()
        if k == now[1] - 1:
            out.append((start, m.end()))
            now = next(want, None)
    return out


def _blocks(items: DataFrame, most: int) -> Iterator[list[tuple[str, bytes]]]:
    block: list[tuple[str, bytes]] = []
    n = 0
    for r in items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.encode("text", "UTF-8").alias("t")).toLocalIterator():
        text = bytes(r["t"] or b"")
        size = len(words_of(text)) + 1
        if block and n + size > most:
            yield block
            block, n = [], 0
        block.append((r["i"], text))
        n += size
    yield block


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, keep: list[str] | None = None
) -> DataFrame:
    """Per document row: the columns in ``keep`` (``doc_id``), ``n_words``, ``hit_words`` and ``spans`` (merged, in
    words and in code points of the original), ``items`` (sorted as strings)."""
    spark = docs.sparkSession
    keep = keep or ["doc_id"]
    span = T.ArrayType(T.ArrayType(T.IntegerType()))
    kept = [docs.schema[c] for c in keep]
    text = F.coalesce(docs["text"], F.lit("")).alias("_text")
    flow = docs.select(*keep, text, F.lit(0).alias("n_words"), F.array().cast(span).alias("hit_words"), F.array().cast("array<string>").alias("items"))
    state = T.StructType([*kept, T.StructField("_text", T.StringType()), T.StructField("n_words", T.IntegerType()), T.StructField("hit_words", span), T.StructField("items", T.ArrayType(T.StringType()))])
    types = pa.list_(pa.list_(pa.int32())), pa.list_(pa.string())
    blocks = _blocks(benchmark, block_words)
    now: DataFrame | None = None
    ahead = next(blocks)
    while ahead is not None:
        block, ahead = spark.sparkContext.broadcast(ahead), next(blocks, None)

        def scan(batches: Iterator[pa.RecordBatch], block=block, name=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            automaton = Automaton.of(name, block, window)
            for batch in batches:
                for part in text_slices(batch, "_text"):
                    at = part.schema.get_field_index
                    counts, spans, names = [], [], []
                    for raw, old, who in zip(
                        part.column("_text").cast(pa.large_binary()).to_pylist(), part.column("hit_words").to_pylist(), part.column("items").to_pylist(), strict=True
                    ):
                        words = words_of(raw)
                        counts.append(len(words))
                        new, seen = [], set(who)
                        for a, b, found in automaton.hits(words):
                            new.append((a, b))
                            seen.update(found)
                        spans.append(merged([*map(tuple, old), *new]) if new else old)
                        names.append(sorted(seen))
                    columns = [part.column(at(c)) for c in [*keep, "_text"]]
                    yield pa.record_batch(
                        [*columns, pa.array(counts, pa.int32()), pa.array(spans, types[0]), pa.array(names, types[1])],
                        [*keep, "_text", "n_words", "hit_words", "items"],
                    )

        flow = flow.mapInArrow(scan, state)
        if ahead is not None:
            flow = materialize(flow, "scanned")
            if now is not None:
                discard(now)
            now = flow
            block.destroy()

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index
            found = [
                to_text(t.as_py(), s) if (s := h.as_py()) else []
                for t, h in zip(batch.column(at("_text")), batch.column(at("hit_words")), strict=True)
            ]
            columns = [batch.column(at(c)) for c in [*keep, "n_words", "hit_words", "items"]]
            yield pa.record_batch([*columns, pa.array(found, types[0])], [*keep, "n_words", "hit_words", "items", "spans"])

    out = T.StructType([*kept, *state.fields[-3:], T.StructField("spans", span)])
    return flow.mapInArrow(locate, out)


def report(found: DataFrame) -> DataFrame:
    hit = F.aggregate("hit_words", F.lit(0), lambda acc, s: acc + s[1] - s[0]).cast("long")
    return found.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )
