"""LM scoring by masked pseudo-likelihood.

A small network, in numpy, predicts each token from the tokens on both sides of it: every offset of the window has an
embedding table, their sum goes through tanh, and two softmax layers give the token.  Tokens are words (folded)
hashed to ``CLASSES`` * ``CLASSES`` values, and P(token) = P(class) * P(member | class), so that a prediction costs
two small layers and not one for all values.  Words are told apart within their value by full counts: P(word) =
P(value) * P(word | value), where of a value with N tokens and D distinct words a word seen n times has n / (N + D), and
all unseen words together D / (N + D).  Words are known by 63 bits of their XXH64.  The counts are a table of all words of
the corpus that is joined in; only its most frequent words, at most ``FREQUENT``, are broadcast, so no key of the join is
hot.  A document's score is the sum of the conditional log-probabilities of all its tokens.

One pass over all texts writes their tokens and the counts of words.  Training passes over all tokens: it takes
several disjoint masks of each text, every one a set of positions ``MASK_EVERY`` apart, and predicts those from their
unmasked surroundings; the masks of all passes together cover every position, so each token of the corpus is a target.
Each task starts from the model of the pass before, learns on its own texts, and returns its changes weighted by the
tokens that it saw; these are added up block by block in the order of the tasks, whatever the order they arrive in, so a
task that runs again changes nothing.  No task holds more than a few blocks, and the driver gets one model.  The
biases start from the counts of all tokens of the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.llm.common import Scratch
from lodestrand.llm.xxh import xxh64_ranges

CLASSES = 64
VALUES = CLASSES * CLASSES
OFFSETS = (-2, -1, 1, 2)
REACH = max(map(abs, OFFSETS))
WIDTH = 24
PASSES = 2
MASK_EVERY = 8
BATCH = 2048
#: Positions of a batch whose logits are worked on together, in a core's cache.
PART = 1024
#: Keys with at most so many rows in a batch are summed together.
FEW = 8
RATE = 0.15
BLOCK = 4096
#: A task hands on its counts when it has so many words.
KNOWN_WORDS = 500_000
FREQUENT = 1 << 18
#: Texts are laid end to end until they have so many tokens.
GROUP = 1 << 16
#: Texts of a batch that are looked up together.
SLICE = 512
ONES = np.ones(CLASSES, np.float32)
EDGE = VALUES  # beyond either end of a document


def word_key(word: str) -> int:
    """63 bits that stand for a word; its value is the rest by ``VALUES``."""
    try:
        return xxhash.xxh64_intdigest(word, 3) >> 1  # of its UTF-8
    except UnicodeEncodeError:  # half a surrogate pair
        return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 3) >> 1


class Words:
    """The words of texts: what lies between white space, in lower case."""

    @staticmethod
    def coded(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The keys of the distinct words, the place among these of each word of the texts, laid end to end, and the
        number of words by text.  Arrow splits and compares words, at the same white space as Python; only distinct ones are
        hashed, all at once."""
        lists = pc.utf8_split_whitespace(pa.array([(t or "").lower() for t in texts], pa.large_string()))
        words = lists.flatten()
        real = pc.not_equal(pc.binary_length(words), 0)  # at white space at either end of a text there is an empty one
        sizes = np.diff(np.concatenate(([0], np.cumsum(real.to_numpy(zero_copy_only=False))))[lists.offsets.to_numpy()])
        known = words.filter(real).dictionary_encode()
        if not len(known):
            return np.zeros(0, np.int64), np.zeros(0, np.int32), sizes
        _, ends, data = known.dictionary.buffers()
        ends = np.frombuffer(ends, np.int64)[: len(known.dictionary) + 1]
        keys = xxh64_ranges(data.to_pybytes(), ends[:-1], np.diff(ends), 3) >> np.uint64(1)
        return keys.astype(np.int64), known.indices.to_numpy(), sizes

    @staticmethod
    def tokens(text: str | None) -> np.ndarray:
        return np.array([word_key(w) % VALUES for w in (text or "").lower().split()], np.uint16)


class Laid:
    """Texts end to end, with edges between them, so that windows of any positions are one indexing away."""

    def __init__(self, texts: list[np.ndarray]):
        sizes = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(sizes)
        gaps = np.repeat(REACH * np.arange(1, len(texts) + 1), sizes)
        self.at = np.arange(int(sizes.sum())) + gaps
        self.place = np.arange(len(self.at)) - np.repeat(self.ends - sizes, sizes)
        self.tokens = np.concatenate([*texts, np.zeros(0, np.uint16)])
        self.padded = np.full(len(self.at) + REACH * (len(texts) + 1), EDGE, np.uint16)
        self.padded[self.at] = self.tokens

    def windows(self, at: np.ndarray) -> np.ndarray:
        """Rows of the embedding table for each position and offset."""
        return np.stack([self.padded[at + o].astype(np.uint16) + np.uint16(k * (VALUES + 1)) for k, o in enumerate(OFFSETS)], axis=1)


def grouped(texts: Iterable[np.ndarray]) -> Iterator[Laid]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= GROUP:
            yield Laid(held)
            held, size = [], 0
    if held:
        yield Laid(held)


def firsts(x: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin."""
    return np.concatenate(([0], np.flatnonzero(x[1:] != x[:-1]) + 1))


def whole(x: np.ndarray) -> np.ndarray:
    """The rows as items, which are put in place in half the time."""
    return x.view(np.dtype((np.void, x.shape[1] * x.itemsize)))[:, 0]


class Network:
    """Parameters by name, as float32 arrays.  Large results of a batch go to arrays that are kept for the next one: getting
    fresh memory for them took longer than the arithmetic."""

    def __init__(self, params: dict[str, np.ndarray]):
        self.p = params
        self.room: dict[str, np.ndarray] = {}

    def __getstate__(self) -> dict:
        return {"p": self.p, "room": {}}

    def kept(self, name: str, rows: int, width: int) -> np.ndarray:
        held = self.room.get(name)
        if held is None or len(held) < rows:
            held = self.room[name] = np.empty((max(rows, BATCH), width), np.float32)
        return held[:rows]

    @classmethod
    def initial(cls, counts: np.ndarray, seed: int = 11) -> Network:
        rng = np.random.default_rng(seed)
        c = (counts + 0.5).reshape(CLASSES, CLASSES)
        return cls({
            "embed": (rng.standard_normal((len(OFFSETS) * (VALUES + 1), WIDTH)) * 0.1).astype(np.float32),
            "layer": np.zeros((WIDTH, 2 * CLASSES), np.float32),  # to the class, and to the member
            "class_bias": np.log(c.sum(axis=1) / c.sum()).astype(np.float32),
            "member_bias": np.log(c / c.sum(axis=1, keepdims=True)).astype(np.float32),
        })

    def hidden(self, rows: np.ndarray) -> np.ndarray:
        """A column for each hidden number, and one of ones, which stands for the class bias."""
        h, more, rows = self.kept("h", len(rows), WIDTH), self.kept("more", len(rows), WIDTH), rows.T.astype(np.intp)
        np.take(self.p["embed"], rows[0], axis=0, out=h, mode="clip")
        for at in rows[1:]:
            h += np.take(self.p["embed"], at, axis=0, out=more, mode="clip")
        out = self.kept("hidden", len(h), WIDTH + 1)
        out[:, WIDTH] = 1
        np.tanh(h, out=out[:, :WIDTH])
        return out

    def layer(self) -> np.ndarray:
        """Of the columns of :meth:`hidden`, to the class and to the member."""
        return np.vstack([self.p["layer"], np.concatenate([self.p["class_bias"], np.zeros(CLASSES, np.float32)])])

    def farthest(self) -> float:
        """No logit is farther from zero: the hidden numbers are between -1 and 1."""
        return max(float(np.abs(self.p[k]).max()) for k in ("class_bias", "member_bias")) + float(np.abs(self.p["layer"]).sum(axis=0).max())

    def exponentials(self, h: np.ndarray, group: np.ndarray, layer: np.ndarray, farthest: float) -> tuple[np.ndarray, np.ndarray]:
        """exp of the logits of all classes and of the members of ``group``, less a number a row, and their sums.  The
        halves are rows of one array: (positions, class or member, entry)."""
        flat = np.matmul(h, layer, out=self.kept("logits", len(h), 2 * CLASSES))
        x = flat.reshape(len(h), 2, CLASSES)
        x[:, 1] += np.take(self.p["member_bias"], group, axis=0, out=self.kept("bias", len(h), CLASSES), mode="clip")
        if farthest > 60:
            x -= x.max(axis=2, keepdims=True)
        np.exp(x, out=x)
        return x, (flat.reshape(-1, CLASSES) @ ONES).reshape(-1, 2)

    def log_probabilities(self, tokens: np.ndarray) -> np.ndarray:
        """The conditional log-probability of each token of a text."""
        return self.scored(Laid([tokens]))

    def scored(self, laid: Laid) -> np.ndarray:
        out, layer, farthest = np.empty(len(laid.at)), self.layer(), self.farthest()
        for i in range(0, len(out), BATCH):
            target = laid.tokens[i : i + BATCH].astype(np.int64)
            group, k = target // CLASSES, np.arange(len(target))
            e, total = self.exponentials(self.hidden(laid.windows(laid.at[i : i + BATCH])), group, layer, farthest)
            ratio = np.maximum(e[k, 0, group] / total[:, 0], 1e-30).astype(np.float64) * np.maximum(e[k, 1, target % CLASSES] / total[:, 1], 1e-30)
            out[i : i + BATCH] = ratio
        return np.log(out, out=out)

    def learn(self, rows: np.ndarray, target: np.ndarray, memory: dict[str, np.ndarray], rate: float = RATE) -> None:
        """One Adagrad step on a batch; ``memory`` has the squared gradients so far."""
        p, n, layer, farthest = self.p, len(target), self.layer(), self.farthest()
        dh, of_layer, of_member = self.kept("dh", n, WIDTH), np.zeros_like(layer), np.zeros((CLASSES, CLASSES), np.float32)
        of_group = self.kept("of_group", PART, CLASSES)
        for i in range(0, n, PART):
            part = target[i : i + PART]
            k, group = np.arange(len(part)), part // CLASSES
            h = self.hidden(rows[i : i + PART])
            e, total = self.exponentials(h, group, layer, farthest)
            e *= (1 / (n * total))[:, :, None]
            flat, hit, d = e.reshape(len(part), 2 * CLASSES), of_group[: len(part)], dh[i : i + PART]
            flat.ravel()[np.concatenate([2 * CLASSES * k + group, 2 * CLASSES * k + CLASSES + part % CLASSES])] -= np.float32(1 / n)
            np.matmul(flat, p["layer"].T, out=d)
            of_layer += h.T @ flat
            hit[:] = 0
            hit[k, group] = 1
            of_member += hit.T @ flat[:, CLASSES:]  # by group: a product is faster than sorting the rows
            slope = np.square(h[:, :WIDTH], out=self.kept("more", len(part), WIDTH))
            d *= np.subtract(np.float32(1), slope, out=slope)
        for name, g in (("layer", of_layer[:WIDTH]), ("class_bias", of_layer[WIDTH, :CLASSES]), ("member_bias", of_member)):
            memory[name] += g * g
            p[name] -= rate * g / np.sqrt(memory[name] + np.float32(1e-8))
        at, g = self._sums(rows.ravel(), dh, rows.shape[1])
        # few rows of many: each is fetched and put back once
        so_far, now, square = (self.kept(x, len(at), WIDTH) for x in ("so_far", "now", "square"))
        np.take(memory["embed"], at, axis=0, out=so_far, mode="clip")
        so_far += np.square(g, out=square)
        whole(memory["embed"])[at] = whole(so_far)
        so_far += 1e-8
        g *= rate
        np.take(p["embed"], at, axis=0, out=now, mode="clip")
        now -= np.divide(g, np.sqrt(so_far, out=so_far), out=square)
        whole(p["embed"])[at] = whole(now)

    def _sums(self, keys: np.ndarray, values: np.ndarray, times: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct keys, and the sum of the rows of each; row k of ``values`` belongs to ``times`` keys."""
        order = np.argsort(keys, kind="stable")  # 16-bit keys are sorted by radix
        ordered, row, width = keys[order], order // times, values.shape[1]
        first = firsts(ordered)
        size = np.diff(first, append=len(keys))
        by_size = np.argsort((FEW + 1 - np.minimum(size, FEW + 1)).astype(np.uint8), kind="stable")
        rank, at = size[by_size], first[by_size]
        out = self.kept("sums", len(at), width)
        np.take(values, row[at], axis=0, out=out, mode="clip")
        # most keys have few rows, and reduceat is slow for those: a row of each of them at a time
        many = int(np.count_nonzero(size > FEW))
        for k in range(1, FEW):
            more = row[at[many : np.count_nonzero(size > k)] + k]
            out[many : many + len(more)] += np.take(values, more, axis=0, out=self.kept("more", len(more), width), mode="clip")
        if many:
            runs = np.take(values, row[np.repeat(size > FEW, size)], axis=0)
            out[:many] = np.add.reduceat(runs, np.cumsum(rank[:many]) - rank[:many], axis=0)
        return ordered[at].astype(np.intp), out

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in sorted(self.p)])

    def like(self, flat: np.ndarray) -> Network:
        out, at = {}, 0
        for k in sorted(self.p):
            n = self.p[k].size
            out[k] = flat[at : at + n].reshape(self.p[k].shape).astype(np.float32)
            at += n
        return Network(out)


@dataclass
class Model:
    """The network over hashed values, and what tells words of one value apart."""

    network: Network
    unseen: np.ndarray  # by value, log P(not a word of the corpus | value)
    keys: np.ndarray  # frequent words
    gains: np.ndarray  # of the frequent words: log P(word | value) less the value's entry of ``unseen``
    rare: DataFrame  # key, gain: the other words


def parse(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tokens) of each text that has any, and (key, n): how often each word occurs in some texts; one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]

        def summed() -> tuple[np.ndarray, np.ndarray]:
            keys, n = map(np.concatenate, zip(*found))
            each, at = np.unique(keys, return_inverse=True)
            return each, np.bincount(at, n, len(each)).astype(np.int64)

        def counts(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n), pa.nulls(len(keys), pa.binary())], ["key", "n", "tokens"])

        for b in batches:
            for first in range(0, b.num_rows, SLICE):
                keys, place, sizes = Words.coded(b.column("text").slice(first, SLICE).to_pylist())
                found.append((keys, np.bincount(place, minlength=len(keys))))
                ends = np.cumsum(np.append(0, sizes[sizes > 0]) * 2).astype(np.int32)
                tokens = (keys % VALUES).astype("<u2")[place]
                lists = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(tokens)])
                yield pa.RecordBatch.from_arrays([pa.nulls(len(lists), pa.int64()), pa.nulls(len(lists), pa.int64()), lists], ["key", "n", "tokens"])
                if sum(len(keys) for keys, _ in found) > 2 * KNOWN_WORDS:
                    found = [summed()]
                    if len(found[0][0]) > KNOWN_WORDS:
                        yield counts(*found.pop())
                        found.append((np.zeros(0, np.int64), np.zeros(0, np.int64)))
        yield counts(*summed())

    parsed = Scratch(texts.sparkSession, "parsed").write(texts.mapInArrow(run, "key bigint, n bigint, tokens binary"), "parsed")
    return parsed.where("tokens is not null").select("tokens"), parsed.where("key is not null").select("key", "n")


def vocabulary(counts: DataFrame, frequent: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, DataFrame]:
    """Tokens of each value, and ``unseen``, ``keys``, ``gains`` and ``rare`` of a model."""
    most = FREQUENT if frequent is None else frequent
    words = Scratch(counts.sparkSession, "vocabulary").write(counts.groupBy("key").agg(F.sum("n").alias("n")), "words")
    tokens, distinct = np.zeros(VALUES, np.int64), np.zeros(VALUES, np.int64)
    value = (F.col("key") % VALUES).cast("int")
    for r in words.groupBy(value.alias("value")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("d")).collect():  # at most VALUES rows
        tokens[r["value"]], distinct[r["value"]] = r["n"], r["d"]
    unseen = np.log(np.where(distinct > 0, distinct / np.maximum(tokens + distinct, 1), 1.0))
    log_distinct = np.log(np.maximum(distinct, 1))
    each = counts.sparkSession.createDataFrame(list(enumerate(log_distinct.tolist())), "value int, log_distinct double")
    # words as frequent as the steps of an eighth of an octave, as many steps as fit
    step = F.floor(F.log2(F.col("n").cast("double")) * 8).cast("int")
    held, floor = 0, 10**6
    for rung, n in sorted(((r["step"], r["d"]) for r in words.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("d")).collect()), reverse=True):  # a few hundred rows
        if held + n > most:
            break
        held, floor = held + n, rung
    often = words.where(step >= floor).toArrow()  # at most ``most`` rows
    order = np.argsort(keys := often["key"].to_numpy())
    keys = keys[order]
    gains = np.log(often["n"].to_numpy()[order].astype(np.float64)) - log_distinct[keys % VALUES]
    rare = words.where(step < floor).withColumn("value", value).join(F.broadcast(each), "value").select("key", (F.log("n") - F.col("log_distinct")).alias("gain"))
    return tokens, unseen, keys, gains, rare


def masks(number: int, passes: int) -> list[int]:
    """The first positions of the masks of a pass; those of all passes are all of MASK_EVERY, dealt out in turn."""
    return [r for r in range(MASK_EVERY) if r % passes == number] or [number % MASK_EVERY]


def learner(start: Network, firsts: list[int]) -> tuple[Network, Callable[[Iterable[np.ndarray]], int]]:
    """A model to train, and a function that trains it on texts and says how many targets it saw."""
    model = start.like(start.flat())
    memory = {k: np.full_like(v, 1e-4) for k, v in model.p.items()}

    def run(texts: Iterable[np.ndarray]) -> int:
        seen = 0
        for laid in grouped(texts):
            on = np.flatnonzero(np.isin(laid.place % MASK_EVERY, firsts))
            for i in range(0, len(on), BATCH):
                at = on[i : i + BATCH]
                model.learn(laid.windows(laid.at[at]), laid.tokens[at].astype(np.int64), memory)
            seen += len(on)
        return seen

    return model, run


def train_pass(tokens: DataFrame, sent: Broadcast, number: int, passes: int, blocks: int) -> np.ndarray | None:
    """The weighted mean of the tasks' changes, flat; None if no task saw a token."""
    firsts = masks(number, passes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = sent.value
        model, learn = learner(start, firsts)
        seen = learn(np.frombuffer(t, "<u2") for b in batches for t in b.column("tokens").to_pylist())
        if seen:
            change, task = (model.flat() - start.flat()).astype(np.float32), TaskContext.get().partitionId()
            parts = [change[i : i + BLOCK].tobytes() for i in range(0, len(change), BLOCK)]
            numbers = [pa.array(np.arange(len(parts)), pa.int32()), pa.array([task] * len(parts), pa.int32()), pa.array([seen] * len(parts), pa.int64())]
            yield pa.RecordBatch.from_arrays([*numbers, pa.array(parts, pa.binary())], ["block", "task", "seen", "part"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for b in batches:
            for block, seen, part in zip(*(b.column(c).to_pylist() for c in ("block", "seen", "part"))):
                x = np.frombuffer(part, np.float32).astype(np.float64) * seen
                if block in sums:
                    sums[block][0] += seen
                    sums[block][1] += x
                else:
                    sums[block] = [seen, x]
        out = [(k, n, x.tobytes()) for k, (n, x) in sums.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.binary()))], ["block", "seen", "part"])

    changes = tokens.mapInArrow(run, "block int, task int, seen bigint, part binary")
    added = changes.repartition(blocks, "block").sortWithinPartitions("block", "task").mapInArrow(add_up, "block int, seen bigint, part binary")
    got = sorted(added.collect(), key=lambda r: r["block"])  # one model
    return np.concatenate([np.frombuffer(r["part"], np.float64) / r["seen"] for r in got]) if got else None


def train(docs: DataFrame, text_col: str = "text", passes: int = PASSES) -> Model:
    """A model trained on all of ``docs``."""
    sc = docs.sparkSession.sparkContext
    tokens, counts = parse(docs.select(F.col(text_col).alias("text")))
    total, unseen, keys, gains, rare = vocabulary(counts)
    model = Network.initial(total)
    blocks = -(-model.flat().size // BLOCK)
    for number in range(passes):
        sent = sc.broadcast(model)
        change = train_pass(tokens, sent, number, passes, blocks)
        if change is not None:
            model = model.like(model.flat() + change)
    return Model(model, unseen, keys, gains, rare)


def lm_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """One row per input row: doc_id, n_tokens, log_probability (the sum), mean_log_probability.

    Null texts and those without words have no tokens: sum zero and mean null.  Ids may be null or repeat, and repeated
    rows each have a row; texts are scored whole: a very long one costs some tens of bytes a word, its windows are made a
    batch at a time.  No rows give no rows; further columns are ignored.
    """
    model = model or train(docs, text_col)
    sent = docs.sparkSession.sparkContext.broadcast((model.network, model.unseen, model.keys, model.gains))
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network, unseen, keys, gains = sent.value
        for b in batches:
            for first in range(0, b.num_rows, SLICE):
                part = b.slice(first, SLICE)
                each, place, sizes = Words.coded(part.column("text").to_pylist())
                stops = np.cumsum(np.append(0, sizes))
                # words that are not frequent count as unseen here; the join adds what they gain by being known
                value, gain, known = each % VALUES, unseen[each % VALUES], np.zeros(len(each), bool)
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, each), len(keys) - 1)
                    known = keys[at] == each
                    gain = gain + np.where(known, gains[at], 0.0)
                tokens = value.astype(np.uint16)[place]
                scores = [network.scored(laid) for laid in grouped(tokens[i:j] for i, j in zip(stops.tolist(), stops[1:].tolist()))]
                sums = np.diff(np.concatenate(([0.0], np.cumsum(np.concatenate([*scores, np.zeros(0)]) + gain[place])))[stops])
                rare = ~known[place]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(rare)))[stops], pa.int32()), pa.array(each[place[rare]]))
                out = [pa.array(sizes, pa.int64()), pa.array(sums), lists]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *out], ["doc_id", "n_tokens", "log_probability", "rare"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    made = rows.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, log_probability double, rare array<bigint>")
    scored = Scratch(docs.sparkSession, "lm").write(made.withColumn("row_id", F.monotonically_increasing_id()), "scored")
    gained = scored.select("row_id", F.explode("rare").alias("key")).join(model.rare, "key").groupBy("row_id").agg(F.sum("gain").alias("gain"))
    total = F.col("log_probability") + F.coalesce("gain", F.lit(0.0))
    mean = F.when(F.col("n_tokens") > 0, total / F.col("n_tokens"))
    return scored.drop("rare").join(gained, "row_id", "left").select("doc_id", "n_tokens", total.alias("log_probability"), mean.alias("mean_log_probability"))
