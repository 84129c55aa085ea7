"""SentencePiece encoding and decoding over a relational lattice.

Texts become units: spaces are written as the meta symbol, one is put in front, and a unit begins where the meta symbol
follows another character.  No piece spans such a place, so units are encoded alone.  The lattice is made by exploding
the substrings of bounded length of each distinct unit and an equi-join with the piece table; the edges of a unit are
then folded.  For BPE models, whose units are many, substrings are exploded only if a rolling hash says that they may be
a piece, and one that occurs often in a chunk is exploded once; the join decides.

For a unigram model the fold is Viterbi's, with Spark's ``aggregate`` over the edges grouped by unit.  The best path of a
BPE model is not the path of the largest sum, so there the fold merges: each step takes, of the edges that join two
neighbouring symbols, the one with the best score, the leftmost of equals.  As an ``aggregate`` that was far too slow
(see the README), so it runs over the same edges in an Arrow map, for many units at once.  Characters without a piece
fall back to bytes, or to the unknown id.

The BPE path has no shuffle.  A task takes its texts in chunks, sends the units that it has not met into the lattice,
and after them the texts; explode and broadcast join keep rows in order, so the edges of a chunk arrive together, ahead
of its texts.  What a task remembers of units is bounded in number and in characters; beyond that it starts afresh.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from operator import itemgetter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

META = "▁"
UNKNOWN_PENALTY = 10.0
#: Characters of a unit whose substrings are cut from one row; longer units take several rows.
WINDOW = 256
#: A chunk ends with the text that brings it to so many characters.
CHUNK = 1 << 20
#: What a task remembers at most, in units and in their characters, when a chunk begins.
KNOWN_UNITS, KNOWN_CHARS = 250_000, 3_000_000
#: Multiplier of the rolling hash, and the bits of it that are looked up.
MULTIPLIER, HASH_BITS = np.uint64(0x9E3779B97F4A7C15), 22
#: Units of up to these lengths are folded together; the work of a step grows with the length, so longer ones have a heap.
WIDTHS = (2, 4, 6, 8, 10, 12, 16, 24, 40, 64)
FOLDED = 1 << 18
#: Bits of an edge's number: place in the chunk's units, then length, then id.
LENGTH_BITS, ID_BITS = 6, 20
#: What a row of a chunk is, in this order: a unit or one of its edges, where substrings occur, all new units (also: forget
#: the others), a text.
EDGES, MARKS, UNITS, AFRESH, TEXTS = ROLES = range(5)
#: Bytes of a row of marks at most: far below what the collector of the JVM takes for huge.
MARK_BYTES = 1 << 17


@dataclass(frozen=True)
class Model:
    """The fixed tables of a model: pieces as (text, id, score), byte ids by value (empty: none), and its kind."""

    pieces: tuple[tuple[str, int, float], ...]
    bytes: tuple[int, ...]
    unknown: int
    merges: bool

    @classmethod
    def load(cls, path: str | None = None) -> Model:
        sp = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
        ids = range(sp.get_piece_size())
        plain = [(sp.id_to_piece(i), i, sp.get_score(i)) for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        codes = {int(sp.id_to_piece(i)[3:5], 16): i for i in ids if sp.is_byte(i)}
        # BPE scores are the merges' ranks, negated; those of unigram models are logarithms
        merges = all(s == int(s) for _, _, s in plain)
        return cls(tuple(plain), tuple(codes[b] for b in sorted(codes)), sp.unk_id(), merges)

    @property
    def longest(self) -> int:
        return max(len(p) for p, _, _ in self.pieces)


def units(text: Column) -> Column:
    """The units of a text; none for null and empty ones."""
    meta = F.concat(F.lit(META), F.replace(text, F.lit(" "), F.lit(META)))
    return F.when(F.length(text) > 0, F.split(meta, f"(?<=[^{META}])(?={META})")).otherwise(F.array().cast("array<string>"))


def split_units(text: str | None) -> list[str]:
    """As :func:`units`, in Python, but without the meta symbol in front of each."""
    if not text:
        return []
    words = (text.replace(META, " ") if META in text else text).split(" ")
    if all(words):
        return words
    out, blanks = [], -1
    for word in words:
        blanks += 1
        if word:
            out.append(META * blanks + word)
            blanks = -1
    if blanks >= 0:
        out.append(META * blanks)
    return out


def piece_table(words: DataFrame, model: Model) -> DataFrame:
    return F.broadcast(words.sparkSession.createDataFrame(list(model.pieces), "piece string, id int, score double"))  # a fixed table


# unigram models --------------------------------------------------------------------------------------------------------


def lattice(words: DataFrame, model: Model) -> DataFrame:
    """unit and ends: for each place e after the first, in order, its edges (s, score, id); characters s to e-1, from 1,
    are a piece.  A character without a piece has an edge with no id.  ``words`` has unit, distinct."""
    poor = min(s for _, _, s in model.pieces) - UNKNOWN_PENALTY
    part = F.explode(F.sequence(F.lit(0), F.floor((F.length("unit") - 1) / WINDOW).cast("int"))).alias("part")
    parts = words.select(F.col("unit").alias("whole"), part).withColumn("unit", F.substring(F.col("whole"), F.col("part") * WINDOW + 1, F.lit(WINDOW + model.longest - 1)))
    places = parts.select("*", F.explode(F.sequence(F.lit(1), F.least(F.lit(WINDOW), F.length("unit")))).alias("s"))
    spans = places.select("*", F.explode(F.sequence(F.lit(1), F.least(F.lit(model.longest), F.length("unit") - F.col("s") + 1))).alias("k"))
    cut = spans.select("whole", "part", "s", "k", F.substring(F.col("unit"), F.col("s"), F.col("k")).alias("piece"))
    found = cut.join(piece_table(words, model), "piece", "left").where("id is not null or k = 1")
    at = F.col("part") * WINDOW + F.col("s")
    edges = found.select(F.col("whole").alias("unit"), (at + F.col("k")).alias("e"), F.struct(at.alias("s"), F.coalesce("score", F.lit(poor)).alias("score"), "id").alias("edge"))
    by_end = edges.groupBy("unit", "e").agg(F.collect_list("edge").alias("edges"))
    return by_end.groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("e", "edges"))).alias("ends"))


def _viterbi(ends: Column) -> Column:
    """(sum, from, id) of the best path to each place; of equal sums the one with the shortest last piece."""

    def step(acc: Column, end: Column) -> Column:
        into = F.transform(end["edges"], lambda e: F.struct((F.element_at(acc, e["s"])["sum"] + e["score"]).alias("sum"), e["s"].alias("from"), e["id"].alias("id")))
        return F.concat(acc, F.array(F.array_max(into)))

    return F.aggregate(ends, F.array(F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("from"), F.lit(None).cast("int").alias("id"))), step)


def encode_units(words: DataFrame, model: Model) -> DataFrame:
    """unit and ids for each row of ``words``, whose units are distinct, by the path with the largest sum."""
    folded = lattice(words.select("unit"), model).select("unit", _viterbi(F.col("ends")).alias("best"))

    def back(bounds: Column, _: Column) -> Column:
        at = F.element_at(bounds, 1)
        return F.when(at > 1, F.concat(F.array(F.element_at(F.col("best"), at)["from"]), bounds)).otherwise(bounds)

    n = F.length("unit")
    path = F.slice(F.aggregate(F.sequence(F.lit(1), n), F.array(n + 1), back), F.lit(2), n)  # the ends of the symbols

    def one(end: Column) -> Column:
        symbol = F.element_at(F.col("best"), end)
        if model.bytes:
            codes = F.hex(F.encode(F.substring(F.col("unit"), symbol["from"], F.lit(1)), "UTF-8"))
            table = F.array(*[F.lit(i) for i in model.bytes])
            other = F.transform(F.sequence(F.lit(1), (F.length(codes) / 2).cast("int")), lambda k: F.element_at(table, F.conv(F.substring(codes, 2 * k - 1, F.lit(2)), 16, 10).cast("int") + 1))
        else:
            other = F.array(F.lit(model.unknown))
        return F.when(symbol["id"].isNotNull(), F.array(symbol["id"])).otherwise(other)

    return folded.select("unit", F.flatten(F.transform(path, one)).alias("ids"))


def _encode_by_sums(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, ids, text; each distinct unit is folded once, and a join gives its ids to the texts."""
    numbered = docs.withColumn("row_id", F.monotonically_increasing_id())
    each = numbered.select("doc_id", "text", "row_id", F.posexplode_outer(units(F.col("text"))).alias("pos", "unit"))
    table = encode_units(each.where("unit is not null").select("unit").distinct(), model)
    ordered = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))))
    grouped = each.join(table, "unit", "left").groupBy("row_id").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.flatten(F.transform(ordered, lambda x: x["ids"])).alias("ids"))
    return grouped.select("doc_id", "ids", "text")


# BPE models ------------------------------------------------------------------------------------------------------------


class Sieve:
    """Tells which substrings may be pieces, for many units at once."""

    def __init__(self, model: Model):
        self.longest = model.longest
        self.pieces, self.heads = (np.zeros(1 << HASH_BITS, bool) for _ in range(2))
        for k in range(2, self.longest + 1):
            texts = [p for p, _, _ in model.pieces if len(p) >= k]
            letters = np.frombuffer("".join(p[:k] for p in texts).encode("utf-32-le"), "<u4").astype(np.uint64).reshape(-1, k)
            h = letters[:, 0]
            for i in range(1, k):
                h = self.rolled(h, letters[:, i])
            at = self.slot(h)
            self.heads[at] = True
            self.pieces[at[[len(p) == k for p in texts]]] = True
        self.place = np.zeros(1 << HASH_BITS, np.uint32)

    @staticmethod
    def rolled(h: np.ndarray, letter: np.ndarray) -> np.ndarray:
        return h * MULTIPLIER + letter

    @staticmethod
    def slot(h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> np.uint64(31))) * MULTIPLIER) >> np.uint64(64 - HASH_BITS)

    def spans(self, letters: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """place * 64 + length, in order, of distinct substrings of two characters and more that may be pieces; and for each
        length the places, in order, where there is one, above the place of the same substring among the distinct ones.
        ``room``: characters from each place to its unit's end."""
        at, h, found, marks = np.arange(len(letters)), letters, [], []
        for k in range(2, self.longest + 1):
            on = np.flatnonzero(room[at] >= k)
            at = at[on]
            h = self.rolled(h[on], letters[at + (k - 1)])
            slot = self.slot(h)
            on = np.flatnonzero(self.pieces[slot])
            here, hit = at[on], slot[on]
            self.place[hit] = here
            first = self.place[hit]  # any place of those with this hash, if its characters are the same
            same = letters[here] == letters[first]
            for j in range(1, k):
                same &= letters[here + j] == letters[first + j]
            first = np.where(same, first, here)
            marks.append(np.stack([here, first]).astype("<u4"))
            found.append((here[here == first] << LENGTH_BITS) + k)
            on = np.flatnonzero(self.heads[slot])
            at, h = at[on], h[on]
        return np.sort(np.concatenate(found)), marks


class Merger:
    """Folds units by merges, over edges given as numbers."""

    def __init__(self, model: Model):
        self.model, self.longest = model, model.longest
        top = max(i for _, i, _ in model.pieces)
        self.none = -np.inf
        self.scores = np.full(top + 2, self.none)  # the last entry, also reached by id -1, is that of no piece
        for _, i, score in model.pieces:
            self.scores[i] = score
        self.codes, self.singles = map(np.array, zip(*sorted((ord(p), i) for p, i, _ in model.pieces if len(p) == 1)))

    def fold(self, new: list[str], edges: np.ndarray, marks: list[np.ndarray]) -> list[bytes]:
        """The ids of each unit as little-endian 32-bit numbers; ``edges`` are the distinct ones of ``new``, laid end to end,
        of two characters and more, and ``marks`` all of them by length: those of one follow from the characters."""
        sizes = np.fromiter(map(len, new), np.int64, len(new))
        ends = np.cumsum(sizes)
        starts, out = ends - sizes, [b""] * len(new)
        places, lengths, ids = edges >> (LENGTH_BITS + ID_BITS), (edges >> ID_BITS) & ((1 << LENGTH_BITS) - 1), (edges & ((1 << ID_BITS) - 1)).astype(np.int32)
        spread, known = [], np.full(int(sizes.sum()), -1, np.int32)
        for k, (here, same) in enumerate(marks, 2):
            on = lengths == k
            known[places[on]] = ids[on]
            got = known[same]
            known[places[on]] = -1
            spread.append((here[got >= 0], got[got >= 0]))
        first = 0
        while first < len(new):  # a bounded number of characters at a time, one unit at least
            last = max(first + 1, int(np.searchsorted(ends, starts[first] + FOLDED, side="right")))
            low = int(starts[first])
            table = np.full((int(ends[last - 1]) - low + 1, self.longest + 1), -1, np.int32)
            for k, (here, got) in enumerate(spread, 2):
                a, b = np.searchsorted(here, np.array([low, ends[last - 1]], here.dtype))
                table[here[a:b] - low, k] = got[a:b]
            letters = np.frombuffer("".join(new[first:last]).encode("utf-32-le"), "<u4").astype(np.int64)
            hit = np.minimum(np.searchsorted(self.codes, letters), len(self.codes) - 1)
            table[:-1, 1] = np.where(self.codes[hit] == letters, self.singles[hit], -1)
            width = np.searchsorted(WIDTHS, sizes[first:last])
            for w in np.unique(width).tolist():
                at = first + np.flatnonzero(width == w)
                if w < len(WIDTHS):
                    self._together(table, starts[at] - low, sizes[at], WIDTHS[w], at, new, out)
                else:
                    for i in at.tolist():
                        out[i] = self._alone(table, int(starts[i]) - low, new[i])
            first = last
        return out

    def _together(self, table: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int, at: np.ndarray, new: list[str], out: list[bytes]) -> None:
        """Every step merges one pair of each unit that has a pair left."""
        flat, step = table.ravel(), self.longest + 1
        ends = (starts + sizes)[:, None]
        bounds = np.minimum(starts[:, None] + np.arange(width + 1), ends)

        def score(left: np.ndarray, right: np.ndarray) -> np.ndarray:
            k = right - left
            return np.where(k < step, self.scores[flat[left * step + np.minimum(k, step - 1)]], self.none)

        # of the pairs beyond a unit's last character, none is one
        joins = np.where(np.arange(width - 1) + 2 <= sizes[:, None], score(bounds[:, :-2], bounds[:, 2:]), self.none)
        while True:
            n = len(bounds)
            rows = np.arange(n)
            best = joins.argmax(axis=1) if joins.shape[1] else np.zeros(n, np.int64)
            go_on = joins[rows, best] > self.none if joins.shape[1] else np.zeros(n, bool)
            if not go_on.all():
                self._finish(flat, step, bounds[~go_on], at[~go_on], new, out)
                bounds, joins, best, at = bounds[go_on], joins[go_on], best[go_on], at[go_on]
                n = len(bounds)
                rows = np.arange(n)
            if not n:
                return
            keep = np.ones(bounds.shape, bool)
            keep[rows, best + 1] = False
            bounds = bounds[keep].reshape(n, -1)
            keep = np.ones(joins.shape, bool)
            keep[rows, best] = False
            joins = joins[keep].reshape(n, -1)
            symbols = bounds.shape[1] - 1
            # the merged symbol has a new pair on either side; a bound that repeats is beyond the unit's end
            on = np.flatnonzero(best + 2 <= symbols)
            k = best[on]
            left, middle, right = bounds[on, k], bounds[on, k + 1], bounds[on, k + 2]
            joins[on, k] = np.where(right > middle, score(left, right), self.none)
            on = np.flatnonzero(best > 0)
            k = best[on]
            joins[on, k - 1] = score(bounds[on, k - 1], bounds[on, k + 1])

    def _finish(self, flat: np.ndarray, step: int, bounds: np.ndarray, at: np.ndarray, new: list[str], out: list[bytes]) -> None:
        k = np.diff(bounds, axis=1)
        ids = flat[bounds[:, :-1] * step + np.minimum(k, step - 1)]
        real = k > 0
        coded = ids[real].astype("<i4").tobytes()
        stops = np.concatenate(([0], 4 * np.cumsum(real.sum(axis=1)))).tolist()
        for i, first, last in zip(at.tolist(), stops, stops[1:]):
            out[i] = coded[first:last]
        for j in np.flatnonzero(((ids < 0) & real).any(axis=1)).tolist():
            out[int(at[j])] = self._bytes(new[int(at[j])], k[j].tolist(), ids[j].tolist())

    def _bytes(self, unit: str, lengths: list[int], ids: list[int]) -> bytes:
        codes, place = [], 0
        for k, i in zip(lengths, ids):
            if i >= 0 and k:
                codes.append(i)
            elif k:
                codes += [self.model.bytes[b] for b in unit[place : place + k].encode()] if self.model.bytes else [self.model.unknown]
            place += k
        return np.array(codes, "<i4").tobytes()

    def _alone(self, table: np.ndarray, start: int, unit: str) -> bytes:
        """One long unit: the pairs wait in a heap."""
        n, longest, scores = len(unit), self.longest, self.scores
        after, before, size, heap = list(range(1, n + 1)), list(range(-1, n - 1)), [1] * n, []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (k := size[i] + size[j]) <= longest and (piece := int(table[start + i, k])) >= 0:
                heapq.heappush(heap, (-scores[piece], i, size[i], size[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            if size[i] != a or (j := after[i]) >= n or size[j] != b:
                continue
            size[i], size[j], after[i] = a + b, 0, after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        lengths, ids, i = [], [], 0
        while i < n:
            lengths.append(size[i])
            ids.append(int(table[start + i, size[i]]))
            i = after[i]
        return self._bytes(unit, lengths, ids)


def _encode_by_merges(docs: DataFrame, model: Model, check: bool = False) -> DataFrame:
    """doc_id, ids, text, in one pass; with ``check`` round_trip in place of text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)["doc_id"]
    longest = model.longest
    if longest >= 1 << LENGTH_BITS or max(i for _, i, _ in model.pieces) >= 1 << ID_BITS:
        raise ValueError("the pieces of this model are too long or too many")
    names = ["chunk", "role", "base", "unit", "spans", "doc_id", "text", "marks"]

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str | None]]]:
        ids, texts, size = [], [], 0
        for b in batches:
            first = 0
            for i, text in enumerate(b.column("text")):
                texts.append(text.as_py())
                size += len(texts[-1] or "")
                if size >= CHUNK:
                    ids.append(b.column("doc_id").slice(first, i + 1 - first))
                    yield pa.concat_arrays(ids), texts
                    ids, texts, size, first = [], [], 0, i + 1
            ids.append(b.column("doc_id").slice(first))
        if texts:
            yield pa.concat_arrays(ids), texts

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met, size, sieve = set(), 0, Sieve(sent.value)
        one = pa.array([[0]], pa.list_(pa.int32()))

        def rows(chunk: int, role: int, n: int, **columns: pa.Array) -> pa.RecordBatch:
            numbers = [pa.array([x] * n, pa.int32()) for x in (chunk, role)]
            base, unit, spans = columns.get("base", pa.nulls(n, pa.int64())), columns.get("unit", pa.nulls(n, pa.string())), columns.get("spans")
            spans = one.take(pa.array([0] * n, pa.int32())) if spans is None else spans
            ids = columns.get("ids", pa.nulls(n, columns["kind"]))
            return pa.RecordBatch.from_arrays([*numbers, base, unit, spans, ids, columns.get("text", pa.nulls(n, pa.string())), columns.get("marks", pa.nulls(n, pa.binary()))], names)

        for chunk, (ids, texts) in enumerate(chunks(batches)):
            forget = len(met) > KNOWN_UNITS or size > KNOWN_CHARS
            if forget:
                met, size = set(), 0
            new = list(set().union(*map(split_units, texts)).difference(met))
            met.update(new)
            if new:
                whole = META + META.join(new)
                sizes = np.fromiter(map(len, new), np.int64, len(new)) + 1
                ends = np.cumsum(sizes)
                size += len(whole)
                found, marks = sieve.spans(np.frombuffer(whole.encode("utf-32-le"), "<u4").astype(np.uint64), np.repeat(ends, sizes) - np.arange(len(whole)))
                base = ends - sizes
                if sizes.max() > WINDOW:
                    base = np.concatenate([np.arange(e - n, e, WINDOW) for e, n in zip(ends.tolist(), sizes.tolist())])
                    stops = np.repeat(ends, -(-sizes // WINDOW))
                else:
                    stops = ends
                stops = np.minimum(stops, base + WINDOW + longest - 1)
                held = np.diff(np.searchsorted(found >> LENGTH_BITS, np.append(base, len(whole))))
                on = np.flatnonzero(held)
                base, stops, held = base[on], stops[on], held[on]
                local = found - (np.repeat(base, held) - 1 << LENGTH_BITS)
                spans = pa.ListArray.from_arrays(pa.array(np.cumsum(np.append(0, held)), pa.int32()), pa.array(local, pa.int32()))
                windows = pa.array([whole[i:j] for i, j in zip(base.tolist(), stops.tolist())], pa.string())
                yield rows(chunk, EDGES, len(base), base=pa.array(base), unit=windows, spans=spans, kind=ids.type)
                coded = b"".join([np.array([m.shape[1] for m in marks], "<u4").tobytes(), *(m.tobytes() for m in marks)])
                for i in range(0, len(coded), MARK_BYTES):
                    yield rows(chunk, MARKS, 1, marks=pa.array([coded[i : i + MARK_BYTES]]), kind=ids.type)
                yield rows(chunk, AFRESH if forget else UNITS, 1, text=pa.array([" ".join(new)]), kind=ids.type)  # no unit holds a space
            yield rows(chunk, TEXTS, len(texts), ids=ids, text=pa.array(texts, pa.string()), kind=ids.type)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger, table, met, edges, marks, before = Merger(sent.value), decoder(sent.value), {}, [], [], (0, EDGES)
        for b in batches:
            state = b.column("chunk").to_numpy().astype(np.int64) * len(ROLES) + b.column("role").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(state)) + 1).tolist(), len(state)]
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                now = divmod(int(state[i]), len(ROLES))
                if now < before:
                    raise RuntimeError("rows of the lattice have lost their order")
                before, part = now, b.slice(i, j - i)
                if now[1] == EDGES:
                    edges.append(part.column("edge").to_numpy())
                elif now[1] == MARKS:
                    marks += part.column("marks").to_pylist()
                elif now[1] == TEXTS:
                    texts = part.column("text").to_pylist()
                    coded = [b"".join(map(met.__getitem__, split_units(t))) for t in texts]
                    flat = np.frombuffer(b"".join(coded), "<i4")
                    stops = np.cumsum([0, *map(len, coded)]) // 4
                    found = pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(flat))
                    if check:
                        ids = flat.tolist()
                        last = pa.array([decode_ids(ids[i:j], table) == (t or "") for i, j, t in zip(stops.tolist(), stops[1:].tolist(), texts)])
                    else:
                        last = part.column("text")
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), found, last], ["doc_id", "ids", "round_trip" if check else "text"])
                else:
                    if now[1] == AFRESH:
                        met = {}
                    new = part.column("text")[0].as_py().split(" ")
                    flat = np.frombuffer(b"".join(marks), "<u4")
                    stops = np.cumsum(np.append(longest - 1, 2 * flat[: longest - 1].astype(np.int64))).tolist()
                    each = [flat[i:j].reshape(2, -1) for i, j in zip(stops, stops[1:])]
                    met.update(zip(new, merger.fold([META + u for u in new], np.concatenate([*edges, np.zeros(0, np.int64)]), each)))
                    edges, marks = [], []

    rows = docs.mapInArrow(cut, f"chunk int, role int, base bigint, unit string, spans array<int>, doc_id {kind}, text string, marks binary")
    each = rows.select("chunk", "role", "base", "unit", "doc_id", "text", "marks", F.explode("spans").alias("span"))
    s, k = F.shiftright("span", LENGTH_BITS), F.col("span").bitwiseAND((1 << LENGTH_BITS) - 1)
    cut_out = each.select("chunk", "role", "base", "doc_id", "text", "marks", F.col("unit").isNull().alias("whole"), s.alias("s"), k.alias("k"), F.substring(F.col("unit"), s, k).alias("piece"))
    found = cut_out.join(piece_table(docs, model), "piece", "left").where("id is not null or whole")
    place = F.shiftleft(F.col("base") + F.col("s") - 1, LENGTH_BITS + ID_BITS)
    edge = place + F.shiftleft(F.col("k").cast("bigint"), ID_BITS) + F.col("id")
    return found.select("chunk", "role", edge.alias("edge"), "doc_id", "text", "marks").mapInArrow(fold, f"doc_id {kind}, ids array<int>, " + ("round_trip boolean" if check else "text string"))


# both ------------------------------------------------------------------------------------------------------------------


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """One row per input row: doc_id, ids, text.

    Null and empty texts have no ids; texts are encoded whole, however long, and so are units of any length.  Ids of
    rows may be null or repeat, and repeated rows each have a row.  No rows give no rows; further columns are ignored.
    """
    model = model or Model.load()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return _encode_by_merges(rows, model) if model.merges else _encode_by_sums(rows, model)


def decode(encoded: DataFrame, model: Model | None = None, ids_col: str = "ids", into: str = "text") -> DataFrame:
    """``encoded`` with the column ``into``, which replaces one of that name.  Bytes are put together again, what is no
    UTF-8 becomes U+FFFD; null lists give null; ids that are null or none of the model's read as unknown ones."""
    model = model or Model.load()
    sent = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decoder(sent.value)
        for b in batches:
            lists = b.column(ids_col)
            ids = pc.fill_null(lists.flatten(), -1).to_numpy().tolist()
            stops = np.cumsum([0, *pc.fill_null(pc.list_value_length(lists), 0).to_pylist()]).tolist()
            texts = [decode_ids(ids[i:j], table) if known else None for i, j, known in zip(stops, stops[1:], lists.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, into])

    base = encoded.drop(into)
    columns = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in base.schema.fields)
    return base.mapInArrow(run, f"{columns}, `{into}` string")


class Decoder(dict):
    """The bytes of each id."""

    def __missing__(self, key: int | None) -> bytes:
        return " ⁇ ".encode()


def decoder(model: Model) -> Decoder:
    return Decoder({i: p.encode() for p, i, _ in model.pieces} | {i: bytes([b]) for b, i in enumerate(model.bytes)})


def decode_ids(ids: list[int], table: Decoder) -> str:
    text = b"".join(itemgetter(*ids)(table) if len(ids) > 1 else [table[i] for i in ids]).decode("utf-8", "replace").replace(META, " ")
    return text[1:] if text.startswith(" ") else text


def encode_checked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """One row per input row: doc_id, n_pieces, ids, round_trip: whether the ids decode to the whole text (null counts as
    empty).  A text that holds the meta symbol itself does not: it reads as a space.  Otherwise as :func:`encode`."""
    model = model or Model.load()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if model.merges:
        back = _encode_by_merges(rows, model, check=True)
    else:
        back = decode(_encode_by_sums(rows, model), model, into="decoded").withColumn("round_trip", F.col("decoded") == F.coalesce("text", F.lit("")))
    return back.select("doc_id", F.size("ids").cast("bigint").alias("n_pieces"), "ids", "round_trip")
