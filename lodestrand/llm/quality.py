"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade >= j | text) = sigmoid(w . x - t_j) with one weight vector w over hashed text features shared by all grades,
and ordered thresholds t_1 < t_2 < ...  The expected grade and the tail probability of the top grades follow; the tail
probability selects.

Features: presence of each hashed word (letters only, folded) and of its first letters, which does not thin out in
long texts, and the share of
words that have a hashed shape (what surrounds the letters, case, and whether the word repeats the one before), which
describes a text of any length.  Weights are fitted on the driver by accelerated proximal gradient steps with an L1
penalty, on a bounded sample of rated rows; scoring is distributed and looks at whole texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rated rows that the fit may use, at most; those with the smallest hashes of their ids are taken.
FIT_ROWS = 6000
WIDTH = 1 << 18
STEPS = 150
L1 = 4e-3
SHAPE_WEIGHT = 8.0
KEEP_TAIL = 0.5
KNOWN_WORDS = 400_000
LONG_TEXT = 4_000_000

LETTERS = re.compile(r"[^\W\d_]+")


def _slot(name: str) -> int:
    return xxhash.xxh32_intdigest(name, 1) % WIDTH


def word_slots(word: str) -> tuple[int, int, int]:
    """The slots of a word's letters and first letters (-1: it has none), and of its shape."""
    m = LETTERS.search(word)
    if not m:
        return -1, -1, _slot("shape:none:" + ("".join(sorted(set(word)))[:4]))
    letters = m[0]
    case = "u" if letters.isupper() and len(letters) > 1 else "t" if letters[0].isupper() else "l"
    tail = "".join(dict.fromkeys(c if not c.isalnum() else "a" for c in word[m.end() :]))[:3]
    head = "".join(dict.fromkeys(c if not c.isalnum() else "a" for c in word[: m.start()]))[:3]
    folded = letters.lower()
    return _slot("word:" + folded), _slot("start:" + folded[:4]) if len(folded) > 5 else -1, _slot(f"shape:{case}:{head}:{tail}")


REPEAT, SHORT = _slot("shape:repeat"), _slot("shape:short")


def features(text: str | None, known: dict[str, tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Slots, each once, and values.  No words: no features but that of a short text."""
    words = (text or "").split()
    if len(known) > KNOWN_WORDS:
        known.clear()
    counts = Counter(words)
    if len(text or "") > LONG_TEXT:  # its words are not remembered
        known = {}
    for w in counts:
        if w not in known:
            known[w] = word_slots(w)
    present, shapes = set(), Counter()
    for w, n in counts.items():
        word, start, shape = known[w]
        shapes[shape] += n
        present.update((word, start))
    present.discard(-1)
    repeats = sum(map(str.__eq__, words, words[1:]))
    n = max(len(words), 1)
    values = {s: SHAPE_WEIGHT * c / n for s, c in shapes.items()}
    values[REPEAT] = SHAPE_WEIGHT * repeats / n
    values[SHORT] = 1 / n if words else 2.0
    for s in present:
        values[s] = values.get(s, 0.0) + 1.0
    return np.fromiter(values, np.int64, len(values)), np.fromiter(values.values(), np.float64, len(values))


class OrdinalModel:
    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def tails(self, slots: np.ndarray, values: np.ndarray) -> np.ndarray:
        """P(grade >= j) for j = 1, 2, ..."""
        z = float(self.weights[slots] @ values)
        return 1 / (1 + np.exp(-np.clip(z - self.thresholds, -500, 500)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, steps: int = STEPS, l1: float = L1) -> OrdinalModel:
    """Maximum likelihood with an L1 penalty.  With no rows, or one grade only, the thresholds alone are fitted."""
    n, top = len(rows), int(grades.max(initial=1))
    if not n:
        return OrdinalModel(np.zeros(WIDTH), np.full(1, -1.0))
    slots, values = np.concatenate([s for s, _ in rows]), np.concatenate([v for _, v in rows])
    ends = np.cumsum([len(s) for s, _ in rows])
    starts = np.concatenate(([0], ends[:-1]))
    owner = np.repeat(np.arange(n), ends - starts)
    share = np.array([np.clip((grades >= j).mean(), 0.5 / n, 1 - 0.5 / n) for j in range(1, top + 1)])
    t = -np.log(share / (1 - share)) + np.arange(top) * 1e-3
    w = np.zeros(WIDTH)
    # rare slots get longer steps (but those of one or two rows none), so that a telling word counts as much as a common one
    rows_of = np.bincount(slots, minlength=WIDTH)
    scale = np.where(rows_of > 2, np.sqrt(n / (rows_of + 10)), 0.0)
    values = values * scale[slots]
    v, curve = np.random.default_rng(0).random(WIDTH), 1.0
    for _ in range(15):  # the largest curvature of the loss, by power iteration
        v = np.bincount(slots, np.add.reduceat(v[slots] * values, starts)[owner] * values, WIDTH) / n
        curve = max(np.linalg.norm(v), 1e-9)
        v = v / curve
    rate = 1.0 / curve
    u, momentum = w.copy(), 1.0
    for _ in range(steps):
        z = np.add.reduceat(u[slots] * values, starts)
        cdf = 1 / (1 + np.exp(-np.clip(np.column_stack([np.full(n, 50.0), *(z - x for x in t), np.full(n, -50.0)]), -50, 50)))
        rows_ = np.arange(n)
        lo, hi = cdf[rows_, grades], cdf[rows_, grades + 1]
        p = np.maximum(lo - hi, 1e-9)
        dlo, dhi = lo * (1 - lo), hi * (1 - hi)
        gz = -(dlo - dhi) / p / n
        gt = np.array([((grades == j) * dlo / p - (grades == j - 1) * dhi / p).sum() / n for j in range(1, top + 1)])
        step = u - rate * np.bincount(slots, gz[owner] * values, WIDTH)
        new = np.sign(step) * np.maximum(np.abs(step) - rate * l1, 0)
        momentum, old = (1 + np.sqrt(1 + 4 * momentum**2)) / 2, momentum
        u, w = new + (old - 1) / momentum * (new - w), new
        t = np.maximum.accumulate(t - gt + np.arange(top) * 1e-6)
    return OrdinalModel(w * scale, t)


def grades_of(labels: DataFrame) -> DataFrame:
    """doc_id and grade: 0 toxic, 1 poor, 2 good.  Rows without a rating are left out; the worst of several counts."""
    toxic, quality = F.coalesce(F.col("toxic"), F.lit(0)), F.col("quality")
    grade = F.when(toxic > 0, 0).when(quality > 0, 2).when(quality.isNotNull(), 1)
    return labels.select("doc_id", grade.alias("grade")).where("grade is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))


def train(docs: DataFrame, grades: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> OrdinalModel:
    """Fits on at most ``fit_rows`` rated rows; what comes to the driver is their slots and values."""
    chosen = grades.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # of several texts under one id the least counts, in whatever order they are read
    rated = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "grade").agg(F.min("text").alias("text")).select("grade", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, int, int]] = {}
        for b in batches:
            found = [features(t.as_py(), known) for t in b.column("text")]
            packed = [pa.array([x[i].astype(kind).tobytes() for x in found], pa.binary()) for i, kind in ((0, "<i4"), (1, "<f4"))]
            yield pa.RecordBatch.from_arrays([b.column("grade"), *packed], ["grade", "slots", "weights"])

    got = rated.mapInArrow(run, "grade int, slots binary, weights binary").collect()
    got.sort(key=lambda r: (r["grade"], bytes(r["slots"]), bytes(r["weights"])))  # the order of tasks must not matter
    rows = [(np.frombuffer(r["slots"], "<i4").astype(np.int64), np.frombuffer(r["weights"], "<f4").astype(np.float64)) for r in got]
    return fit(rows, np.array([r["grade"] for r in got], np.int64))


def score(docs: DataFrame, model: OrdinalModel, text_col: str = "text", keep_tail: float = KEEP_TAIL, names: tuple[str, str, str] = ("expected_grade", "tail_probability", "kept")) -> DataFrame:
    """``docs`` with expected grade, probability of the best grade, and whether that is at least ``keep_tail``.

    Null and empty texts are scored by the feature of a short text.  Columns of ``docs`` that have one of ``names``
    are replaced; all others pass through.  One pass, no shuffle.
    """
    sc = docs.sparkSession.sparkContext
    used = np.flatnonzero(model.weights)
    sent = sc.broadcast((used, model.weights[used], model.thresholds))  # at most WIDTH weights
    base = docs.drop(*names)
    width = WIDTH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, weights, thresholds = sent.value
        full = np.zeros(width)
        full[slots] = weights
        local, known = OrdinalModel(full, thresholds), {}
        for b in batches:
            tails = np.array([local.tails(*features(t.as_py(), known)) for t in b.column(text_col)]).reshape(-1, len(thresholds))
            out = [pa.array(tails.sum(axis=1)), pa.array(tails[:, -1]), pa.array(tails[:, -1] >= keep_tail)]
            yield pa.RecordBatch.from_arrays([*b.columns, *out], [*b.schema.names, *names])

    columns = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in base.schema.fields)
    return base.mapInArrow(run, f"{columns}, {names[0]} double, {names[1]} double, {names[2]} boolean")


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, expected_grade (0 to 2), tail_probability (of grade 2), kept.

    Ids may be null or repeat; no rows give no rows.  Without any rated row everything is kept.
    """
    model = train(docs, grades_of(labels), id_col, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return score(rows, model).drop("text")
