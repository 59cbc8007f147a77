"""SentencePiece encoding and decoding by a max-plus parallel scan.

The public vocabulary is byte-pair: pieces merge by score, so its encoding is not a best sum of piece
scores. It is still a best path: put weight 0 on a pair of neighbouring pieces that, encoded together,
stay the same two pieces, and minus infinity on any other pair; then the one path of weight 0 through
the lattice of pieces is the byte-pair encoding. (A local test on neighbours decides the whole.)

Max-plus products of these weights are associative, so giant documents are scanned in parallel:

1. a document of over ``giant`` characters is cut into chunks of ``chunk`` characters, rows of their own;
2. each chunk yields its transfer matrix between boundary states, sparse, weights 0 only. A state is
   the piece that holds the last character before the boundary, and how far it reaches over;
3. the matrices are combined associatively, ``fan`` neighbours at a time, level upon level, until each document has one
   group; from there down each group's states at its boundaries follow from those at its ends: the one state
   that the products from the left and from the right both reach. No task sees more than ``fan`` matrices;
4. each chunk backtraces its path between its two states on its own, and the ids are joined in order.

No piece has a blank after another character, so every path has a boundary before each blank that follows a word.
Between such places the same lattice is walked word by word, depth first with the longest piece first, and the words
found are kept in a bounded cache. A word is first cut between neighbouring characters that no piece holds side by side:
every path has a boundary there, and as nothing can merge across it, the paths of the two sides don't depend on each other. Documents of up to ``giant`` characters are one chunk without boundaries and take
only this last step, in a narrow pass. The library reads the vocabulary file, nothing more; tests compare its ids.

Decoding joins the pieces' bytes and drops the leading blank that encoding adds. Encoding is exactly
reversible: a literal U+2581, which the format would turn into a blank, is written as its three bytes.

Defined cases: null text has null ids; empty text has no ids; repeated rows are encoded each; texts of any length
are encoded whole; an empty table gives an empty result; the columns in ``keep`` stay, other columns don't, and a kept
column of a name the result needs (``ids``, ``round_trip``) is an error. Ids equal the library's for texts without U+2581.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, only, text_slices

CHUNK, GIANT, FAN = 32_768, 65_536, 64
#: Words and parts of words (of two generations each), and pairs of pieces that a worker keeps at most.
CACHED, PAIRS = 100_000, 200_000
BAR = "\u2581"
UNIT = re.compile(f"{BAR}| *[^ {BAR}]+| +")
SYNC = re.compile(f"(?<=[^ ]) |(?<={BAR}).|{BAR}", re.S)

State = tuple[str, int]


class Codec:
    """A vocabulary file with its lattice weights; one per worker process and file."""

    def __init__(self, model: bytes):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        sp = self.library
        self.ids, self.scores, self.bytes_of, self.byte_ids = {}, {}, [], [0] * 256
        for i in range(len(sp)):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:-1], 16)
                self.byte_ids[value] = i
                self.bytes_of.append(bytes([value]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes_of.append(b"")
            else:
                text = piece.replace(BAR, " ")
                self.ids[text], self.scores[text] = i, sp.get_score(i)
                self.bytes_of.append(text.encode())
        self.longest = max(map(len, self.ids))
        #: Beginnings of pieces: 1 if longer pieces begin so, plus 2 for a piece itself.
        self.begun: dict[str, int] = {}
        for t in self.ids:
            for k in range(2, len(t)):
                self.begun[t[:k]] = self.begun.get(t[:k], 0) | 1
            if len(t) > 1:
                self.begun[t] = self.begun.get(t, 0) | 2
        #: Neighbouring characters that some piece holds side by side.
        self.beside = {t[i : i + 2] for t in self.ids for i in range(len(t) - 1)}
        #: Weights by the first piece of a pair, then the second; how many there are.
        self.pairs: dict[str, dict[str, bool]] = {}
        self.n_pairs = 0
        #: Ids of words, lately used ones and those before.
        self.units: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.same = {t: t for t in self.ids}
        #: Order in which pieces of several characters merge, and what each is made of.
        order = {x: k for k, x in enumerate(sorted({self.scores[t] for t in self.ids if len(t) > 1}, reverse=True))}
        self.rank = {t: order[self.scores[t]] for t in self.ids if len(t) > 1}
        self.made_of: dict[str, tuple[str, str] | None] = {}

    @classmethod
    def of(cls, model) -> Codec:
        """``model`` is a broadcast (name, bytes)."""
        name, raw = model.value
        loaded = only("codec")
        if name not in loaded:
            loaded[name] = cls(raw)
        return loaded[name]

    # -- pieces and weights ---------------------------------------------------------------------

    def merge(self, text: str) -> list[str]:
        """Byte-pair encoding of a short text: the best-scored, leftmost merge, until none is left."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def halves(self, t: str) -> tuple[str, str] | None:
        """The two pieces whose merge makes ``t``, in the encoding of ``t`` alone; None if that isn't ``t``."""
        found = self.made_of.get(t, self)
        if found is self:
            parts, found = list(t), None
            while len(parts) > 1:
                best, at = None, -1
                for i in range(len(parts) - 1):
                    s = self.scores.get(parts[i] + parts[i + 1])
                    if s is not None and (best is None or s > best):
                        best, at = s, i
                if at < 0:
                    break
                if len(parts) == 2:
                    found = parts[0], parts[1]
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.made_of[t] = found
        return found

    def stable(self, a: str, b: str) -> bool:
        """Whether two neighbours stay as they are when encoded together: the later merge of the two is undone, step by
        step, and no merge across their border may have come before it. Of equal merges the left one comes first."""
        if (len(a) > 1 and self.halves(a) is None) or (len(b) > 1 and self.halves(b) is None):
            return False
        if not a:
            return True
        rank, before = self.rank, len(self.rank) + 1
        while True:
            across = rank.get(a + b)
            if across is not None and across < before:
                return False
            ra, rb = rank.get(a, -1), rank.get(b, -1)
            if ra > rb:
                before, a = ra, self.halves(a)[1]  # type: ignore[index]
            elif rb >= 0:
                before, b = rb + 1, self.halves(b)[0]  # type: ignore[index]
            else:
                return True

    def follows(self, a: str, b: str) -> bool:
        """Weight 0 (True) or minus infinity between neighbours; ``a`` is empty at the start."""
        known = self.pairs.get(a)
        if known is None:
            known = self.pairs[self.same.get(a, a)] = {}
        found = known.get(b)
        if found is None:
            if self.n_pairs > PAIRS:
                self.pairs.clear()
                known, self.n_pairs = self.pairs.setdefault(a, {}), 0
            found = known[self.same.get(b, b)] = self.stable(a, b)
            self.n_pairs += 1
        return found

    def at(self, text: str, p: int) -> Iterator[str]:
        """The pieces that start at ``p``; a single character always does."""
        yield text[p]
        for n in range(2, min(self.longest, len(text) - p) + 1):
            if text[p : p + n] in self.ids:
                yield text[p : p + n]

    def to_ids(self, piece: str) -> list[int]:
        i = self.ids.get(piece)
        return [i] if i is not None else [self.byte_ids[b] for b in piece.encode()]

    def parts(self, u: str) -> list[str]:
        """A unit cut wherever no piece holds both neighbours."""
        beside, out, b = self.beside, [], 0
        for i in range(1, len(u)):
            if u[i - 1 : i + 1] not in beside:
                out.append(u[b:i])
                b = i
        out.append(u[b:])
        return out

    def packed(self, pieces: list[str]) -> bytes:
        """Ids of pieces as int32 bytes."""
        try:
            return array("i", [self.ids[t] for t in pieces]).tobytes()
        except KeyError:
            return array("i", [i for t in pieces for i in self.to_ids(t)]).tobytes()

    def unit(self, u: str) -> bytes:
        """Ids of a word with the blanks before it, as int32 bytes."""
        found = self.kept(u)
        if found is None:
            parts = self.parts(u)
            found = self.part(u) if len(parts) == 1 else b"".join([self.units.get(t) or self.part(t) for t in parts])
            self.keep(u, found)
        return found

    def part(self, t: str) -> bytes:
        found = self.kept(t)
        if found is None:
            found = self.packed(self.search(t))
            self.keep(t, found)
        return found

    def kept(self, u: str) -> bytes | None:
        found = self.units.get(u)
        if found is None:
            found = self.older.get(u)
            if found is not None:
                self.keep(u, found)
        return found

    def keep(self, u: str, found: bytes) -> None:
        if len(u) <= 64:
            if len(self.units) >= CACHED:
                self.older, self.units = self.units, {}
            self.units[u] = found

    def ends(self, u: str, p: int) -> list[int]:
        """Where the pieces that start at ``p`` end, longest last."""
        n, begun = len(u), self.begun
        k = p + 1
        out = [k]
        while k < n:
            k += 1
            kind = begun.get(u[p:k])
            if kind is None:
                break
            if kind > 1:
                out.append(k)
            if kind == 2:
                break
        return out

    def walk(self, u: str) -> list[str]:
        """The path of weight 0 through a unit's lattice, part by part."""
        return [t for part in self.parts(u) for t in self.search(part)]

    def search(self, u: str) -> list[str]:
        """The path of weight 0 through a lattice, depth first, the longest piece first; dead ends are met once. There is one
        such path only, so whatever reaches the end is it."""
        n, pieces, options = len(u), [], []
        dead: set[tuple[int, str]] = set()
        p, last, ends = 0, "", self.ends(u, 0)
        while True:
            known = self.pairs.get(last)
            while ends:
                e = ends.pop()
                t = u[p:e]
                ok = known.get(t) if known is not None else None
                if ok is None:
                    ok = self.follows(last, t)
                    known = self.pairs.get(last)
                if ok and not (dead and (e, t) in dead):
                    break
            else:
                if not pieces:
                    raise ValueError("the lattice has no path")
                dead.add((p, last))
                p -= len(pieces.pop())
                last, ends = pieces[-1] if pieces else "", options.pop()
                continue
            pieces.append(t)
            if e == n:
                return pieces
            options.append(ends)
            p, last, ends = e, t, self.ends(u, e)

    def units_of(self, text: str) -> bytes:
        units, unit = self.units, self.unit
        out = [units.get(u) or unit(u) for u in UNIT.findall(text)]
        return b"".join(out)

    # -- the scan -------------------------------------------------------------------------------

    def _forward(self, text: str, stop: int, starts: list[tuple[State, int]], at: int):
        """Reachable (position, piece) with sets of starts as bit masks, and for each who came before."""
        alive: dict[int, dict[str, int]] = {}
        before: dict[tuple[int, str], str] = {}
        out: dict[State, int] = {}
        for (piece, over), mask in starts:
            if at + over >= stop:
                out[piece, at + over - stop] = out.get((piece, at + over - stop), 0) | mask
            else:
                alive.setdefault(at + over, {})[piece] = alive.get(at + over, {}).get(piece, 0) | mask
        for p in range(at, stop):
            here = alive.pop(p, None)
            if not here:
                continue
            for t in self.at(text, p):
                mask = 0
                for last, m in here.items():
                    if self.follows(last, t):
                        mask |= m
                        before[p + len(t), t] = last
                if not mask:
                    continue
                end = p + len(t)
                if end >= stop:
                    out[t, end - stop] = out.get((t, end - stop), 0) | mask
                else:
                    row = alive.setdefault(end, {})
                    row[t] = row.get(t, 0) | mask
        return out, before

    def path(self, text: str, at: int, stop: int, start: State, end: State | None) -> list[str]:
        """The pieces after ``start`` up to ``end`` (None: the end of the text, reached exactly)."""
        out, before = self._forward(text, stop, [(start, 1)], at)
        if end is None:
            end = next(s for s in out if s[1] == 0)
        piece, p = end[0], stop + end[1]
        pieces: list[str] = []
        while (p, piece) in before:
            pieces.append(piece)
            p, piece = p - len(piece), before[p, piece]
        return pieces[::-1]

    def cuts(self, text: str, b: int, e: int) -> tuple[int, int] | None:
        """First and last place in (b, e) where every path has a boundary."""
        first = SYNC.search(text, b + 1, e)
        if not first:
            return None
        p = first.start()
        for m in SYNC.finditer(text, max(p, e - 512), e):
            p = m.start()
        return first.start(), p

    def entries(self, text: str, b: int) -> list[State]:
        if b == 0:
            return [("", 0)]
        return [
            (text[i:j], j - b)
            for i in range(max(0, b - self.longest), b)
            for j in range(b, min(len(text), i + self.longest) + 1)
            if j - i == 1 or text[i:j] in self.ids
        ]

    def transfer(self, text: str, b: int, e: int, last: bool) -> list[tuple[State, State]]:
        """Entries of weight 0 of the chunk's matrix. ``text`` holds the chunk at [b, e) and its surroundings."""
        states = self.entries(text, b)
        starts = [(s, 1 << k) for k, s in enumerate(states)]
        cut = self.cuts(text, b, e)
        if cut:
            done, _ = self._forward(text, cut[0], starts, b)
            mask = 0
            for (_, over), m in done.items():
                mask |= m if over == 0 else 0
            out, _ = self._forward(text, e, [(("", 0), 1)], cut[1])
            pairs = [(s, x) for x in out for k, s in enumerate(states) if mask >> k & 1]
        else:
            out, _ = self._forward(text, e, starts, b)
            pairs = [(s, x) for x, m in out.items() for k, s in enumerate(states) if m >> k & 1]
        return [p for p in pairs if not last or p[1][1] == 0]

    def backtrace(self, text: str, b: int, e: int, start: State, end: State) -> bytes:
        cut = self.cuts(text, b, e)
        if not cut:
            parts, middle, rest = self.path(text, b, e, start, end), b"", []
        else:
            done, _ = self._forward(text, cut[0], [(start, 1)], b)
            parts = self.path(text, b, cut[0], start, next(s for s in done if s[1] == 0))
            middle = self.units_of(text[cut[0] : cut[1]])
            rest = self.path(text, cut[1], e, ("", 0), end)
        return self.packed(parts) + middle + self.packed(rest)

    # -- whole texts ----------------------------------------------------------------------------

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.units_of(" " + text) if text else b"", np.int32)

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")[1:]


def product(left: list[tuple[State, State]], right: list[tuple[State, State]]) -> list[tuple[State, State]]:
    """Max-plus product of two sparse matrices whose entries all weigh 0."""
    rows: dict[State, list[State]] = {}
    for a, b in right:
        rows.setdefault(a, []).append(b)
    return sorted({(a, c) for a, b in left for c in rows.get(b, [])})


def resolve(matrices: list[list[tuple[State, State]]], start: State = ("", 0), end: State | None = None) -> list[State]:
    """The one state at every boundary, first and last included, that prefix and suffix products leave."""
    ahead = [{start}]
    for m in matrices:
        ahead.append({b for a, b in m if a in ahead[-1]})
    back = [ahead[-1] if end is None else ahead[-1] & {end}]
    for m in reversed(matrices):
        back.append({a for a, b in m if b in back[-1]})
    states = [a & b for a, b in zip(ahead, reversed(back), strict=True)]
    if any(len(s) != 1 for s in states):
        raise ValueError("the lattice has no single path")
    return [next(iter(s)) for s in states]


MATRIX = "key string, k int, a string, a_over int, b string, b_over int"


def _matrices(rows: pd.DataFrame) -> tuple[list[int], list[list[tuple[State, State]]]]:
    """A group's matrices in order, with their numbers."""
    by: dict[int, list[tuple[State, State]]] = {}
    for r in rows.itertuples():
        by.setdefault(r.k, []).append(((r.a, r.a_over), (r.b, r.b_over)))
    numbers = sorted(by)
    return numbers, [by[k] for k in numbers]


def _rows(key: str, entries: list[tuple[int, State, State]]) -> pd.DataFrame:
    flat = [(key, k, *a, *b) for k, a, b in entries]
    return pd.DataFrame(flat, columns=["key", "k", "a", "a_over", "b", "b_over"])


def boundary_states(matrices: DataFrame, n: int, fan: int = FAN) -> DataFrame:
    """Transfer matrices (``MATRIX`` rows) of documents with up to ``n`` chunks -> the true state before and after each."""
    group = F.floor(F.col("k") / fan).cast("int")

    def multiply(rows: pd.DataFrame) -> pd.DataFrame:
        numbers, ms = _matrices(rows)
        while len(ms) > 1:  # neighbours pair by pair: the product is associative
            ms = [product(*ms[i : i + 2]) if i + 1 < len(ms) else ms[i] for i in range(0, len(ms), 2)]
        return _rows(rows["key"].iloc[0], [(numbers[0] // fan, a, b) for a, b in ms[0]])

    def located(rows: pd.DataFrame, start: State, end: State | None) -> pd.DataFrame:
        numbers, ms = _matrices(rows)
        states = resolve(ms, start, end)
        return _rows(rows["key"].iloc[0], [(k, states[i], states[i + 1]) for i, k in enumerate(numbers)])

    def top(rows: pd.DataFrame) -> pd.DataFrame:
        return located(rows, ("", 0), None)

    def inner(rows: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        o = outer.iloc[0]
        return located(rows, (o["a"], int(o["a_over"])), (o["b"], int(o["b_over"])))

    levels = [matrices]
    while n > fan:
        n = -(-n // fan)
        levels.append(materialize(levels[-1].withColumn("g", group).groupBy("key", "g").applyInPandas(multiply, MATRIX), "products"))
    states = levels.pop().groupBy("key").applyInPandas(top, MATRIX)
    while levels:
        lower = levels.pop().withColumn("g", group).groupBy("key", "g")
        states = lower.cogroup(states.withColumn("g", F.col("k")).groupBy("key", "g")).applyInPandas(inner, MATRIX)
    return states


def _model(df: DataFrame, path: str):
    with open(path, "rb") as f:  # a parameter of the driver; workers get it by broadcast, half a megabyte
        return df.sparkSession.sparkContext.broadcast((path, f.read()))


def _giant_ids(giants: DataFrame, model, chunk: int, fan: int) -> DataFrame:
    """``key, text`` (distinct keys) -> ``key, ids``; every chunk is a row and may be on any executor."""
    margin = Codec.of(model).longest
    types = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.bool_()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(*(batch.column(c).to_pylist() for c in ("key", "text")), strict=True):
                text = " " + text
                for k, b in enumerate(range(0, len(text), chunk)):
                    e = min(len(text), b + chunk)
                    left = max(0, b - margin)
                    row = [[key], [k], [text[left : e + margin]], [b - left], [e - left], [e == len(text)]]
                    yield pa.record_batch([pa.array(v, t) for v, t in zip(row, types, strict=True)], ["key", "k", "text", "b", "e", "last"])

    def transfers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(model)
        for batch in batches:
            rows = batch.to_pylist()
            found = [codec.transfer(r["text"], r["b"], r["e"], r["last"]) for r in rows]
            flat = [(r["key"], r["k"], *a, *b) for r, m in zip(rows, found, strict=True) for a, b in m]
            columns = list(zip(*flat, strict=True)) if flat else [[]] * 6
            types = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.int32()]
            yield pa.record_batch(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["key", "k", "a", "a_over", "b", "b_over"]
            )

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(model)
        for batch in batches:
            rows = batch.to_pylist()
            ids = [
                np.frombuffer(codec.backtrace(r["text"], r["b"], r["e"], (r["a"], r["a_over"]), (r["b_piece"], r["b_over"])), np.int32)
                for r in rows
            ]
            yield pa.record_batch(
                [pa.array([r["key"] for r in rows], pa.string()), pa.array([r["k"] for r in rows], pa.int32()), pa.array(ids, pa.list_(pa.int32()))],
                ["key", "k", "ids"],
            )

    chunks = materialize(
        giants.mapInArrow(cut, "key string, k int, text string, b int, e int, last boolean").repartition("key", "k"), "chunks"
    )
    matrices = materialize(chunks.mapInArrow(transfers, MATRIX), "matrices")
    most = matrices.agg(F.max("k").alias("k")).first()["k"]
    states = boundary_states(matrices, 0 if most is None else most + 1, fan)
    joined = chunks.join(states.withColumnRenamed("b", "b_piece"), ["key", "k"])
    traced = joined.select("key", "k", "text", "b", "e", "a", "a_over", "b_piece", "b_over").mapInArrow(trace, "key string, k int, ids array<int>")
    return traced.groupBy("key").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])).alias("ids"))


def encode(
    docs: DataFrame, model_path: str, chunk: int = CHUNK, giant: int = GIANT, keep: list[str] | None = None, check: bool = False, fan: int = FAN
) -> DataFrame:
    """Adds ``ids`` (array of int) to the columns in ``keep`` (``doc_id, text``) of every document row.

    With ``check``, also ``round_trip``: whether decoding gives the text back. Short documents are decoded
    by the worker that encoded them, so ids don't travel to another one.
    """
    keep = keep or ["doc_id", "text"]
    model = _model(docs, model_path)
    own = [docs.schema[c] for c in keep]
    text = F.col("text")
    is_giant = F.coalesce(F.char_length(text) > giant, F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(model)
        for batch in batches:
            for part in text_slices(batch, "_text"):
                texts = part.column("_text").to_pylist()
                ids = [None if t is None else codec.encode(t) for t in texts]
                columns, names = [*(part.column(c) for c in keep), pa.array(ids, pa.list_(pa.int32()))], [*keep, "ids"]
                if check:
                    same = [t is None or codec.decode(i.tolist()) == t for t, i in zip(texts, ids, strict=True)]
                    columns, names = [*columns, pa.array(same, pa.bool_())], [*names, "round_trip"]
                yield pa.record_batch(columns, names)

    schema = T.StructType([*own, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    schema = schema.add("round_trip", "boolean") if check else schema
    short = docs.where(~is_giant).select(*keep, text.alias("_text")).mapInArrow(run, schema)
    giants = docs.where(is_giant).select(*keep, text.alias("_text"), F.sha2(text, 256).alias("_key"))
    texts = giants.groupBy("_key").agg(F.first("_text").alias("text")).withColumnRenamed("_key", "key")
    traced = _giant_ids(texts, model, chunk, fan)
    long = giants.join(traced, F.col("_key") == F.col("key"))
    if check:
        back = decode(long.select(*keep, "_text", "ids"), model_path)
        return short.union(back.select(*keep, "ids", (F.col("decoded") == F.col("_text")).alias("round_trip")))
    return short.union(long.select(*keep, "ids"))


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """Adds ``decoded`` to rows with ``ids``; the other columns stay."""
    model = _model(encoded, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(model)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = []
                for ids in part.column("ids"):
                    texts.append(codec.decode(ids.values.to_pylist()) if ids.is_valid else None)
                yield pa.record_batch([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, "decoded"])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())]))
