"""Toxicity by a subsequence string kernel, Nyström landmarks and a linear support vector machine.

The kernel counts the subsequences of ``p`` letters that a word and a landmark share, each weighted by ``decay`` for
every letter it spans in either, divided by the landmark's own value: 1 for a word that contains the landmark,
``decay`` less for each letter inserted in between, and 0 where that comes to less than 0.1. Landmarks are starts of
words, ``p`` to 8 letters long, that mark the toxic among the labelled texts in many contexts, and few others. So
insults of fewer than ``p`` letters are not told. A sentence is described by its largest kernel value for each landmark,
mapped by the inverse square root of the landmarks' own kernel (Nyström); a linear machine with squared hinge loss
separates witness sentences, the worst of each labelled text, chosen anew in each round. A text scores by its worst
sentence and by how many of its words lie in sentences that the machine calls toxic, through a logistic curve fitted
to the labelled texts.

Words longer than a window are read in overlapping windows, so texts are read whole. A run of single letters is one
word, also with signs or stops between them. The kernel is 0 for a word and landmark whose longest common subsequence
is shorter than ``p``; those are told by bits, so the quadratic part is left to the few words that can matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import held, per_text, ship, staged

_WINDOW, _STEP, _LONGEST, _CACHE_WORDS = 24, 12, 8, 1 << 18
_ENDS = frozenset(".!?\n")
_SINGLE = object()
Sentence = tuple[dict[int, float], int]


def kernel(a: np.ndarray, b: np.ndarray, p: int, decay: float) -> np.ndarray:
    """The subsequence kernel of each row of a with the same row of b; both hold letters padded with 0."""
    rows, n, m = len(a), a.shape[1], b.shape[1]
    inner = np.ones((n + 1, rows, m + 1))
    for _ in range(p - 1):
        nxt = np.zeros_like(inner)
        for i in range(1, n + 1):
            run = np.zeros(rows)
            for j in range(1, m + 1):
                hit = (a[:, i - 1] == b[:, j - 1]) & (b[:, j - 1] > 0)
                run = decay * run + np.where(hit, decay * decay * inner[i - 1, :, j - 1], 0)
                nxt[i, :, j] = decay * nxt[i - 1, :, j] + run
        inner = nxt
    total = np.zeros(rows)
    for i in range(1, n + 1):
        hit = (a[:, i - 1, None] == b) & (b > 0)
        total += (decay * decay * inner[i - 1, :, :m] * hit).sum(1)
    return total


def _letters(words: list[str], width: int) -> np.ndarray:
    joined = "".join([w[:width].ljust(width, "\0") for w in words])
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), width)


@dataclass
class Landmarks:
    """Kernel values of words with a set of landmark strings."""

    strings: list[str]
    p: int = 4
    decay: float = 0.6
    table: np.ndarray = field(init=False)

    def __post_init__(self):
        self.codes = _letters(self.strings, _LONGEST)
        self.own = kernel(self.codes, self.codes, self.p, self.decay)
        self.letters = np.unique(self.codes[self.codes > 0])
        self.table = np.zeros((1 + len(self.letters), len(self.strings)), np.uint8)
        for k, c in enumerate(self.codes):
            for i, x in enumerate(c[c > 0]):
                self.table[1 + np.searchsorted(self.letters, x), k] |= np.uint8(1 << i)
        k = np.array([[self._value([a], [j])[0] for j in range(len(self.strings))] for a in self.strings]) if self.strings else np.zeros((0, 0))
        gram = (k + k.T) / 2
        values, vectors = np.linalg.eigh(gram + 1e-3 * np.eye(len(gram))) if len(gram) else (np.zeros(0), gram)
        self.nystrom = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T

    def _value(self, words: list[str], which: list[int]) -> np.ndarray:
        width = min(_WINDOW, max(map(len, words), default=1))
        return np.minimum(1, kernel(_letters(words, width), self.codes[which], self.p, self.decay) / self.own[which])

    def _common(self, c: np.ndarray) -> np.ndarray:
        """Length of the longest common subsequence of each row of letters with each landmark, one bit for each of its letters."""
        at = np.minimum(np.searchsorted(self.letters, c), len(self.letters) - 1)
        at = np.where(self.letters[at] == c, at + 1, 0)
        state = np.full((len(c), len(self.strings)), 255, np.uint8)
        for i in range(c.shape[1]):
            met = state & self.table[at[:, i]]
            state = (state + met) | (state - met)
        return 8 - np.bitwise_count(state)

    def __call__(self, words: list[str]) -> dict[int, dict[int, float]]:
        """For each word (by position) with a value of 0.1 or more: landmark to value."""
        out: dict[int, dict[int, float]] = {}
        if not len(self.letters):
            return out
        windows: list[tuple[str, int]] = []
        for i, w in enumerate(words):
            if self.p <= len(w) <= _WINDOW:
                windows.append((w, i))
            elif len(w) > _WINDOW:
                windows += [(w[a : a + _WINDOW], i) for a in range(0, len(w) - _WINDOW + _STEP, _STEP)]
        windows.sort(key=lambda x: len(x[0]))
        for at in range(0, len(windows), 4096):
            part = windows[at : at + 4096]
            w, l = np.nonzero(self._common(_letters([x for x, _ in part], len(part[-1][0]))) >= self.p)
            for b in range(0, len(w), 8192):
                wi, li = w[b : b + 8192].tolist(), l[b : b + 8192].tolist()
                for x, y, v in zip(wi, li, self._value([part[i][0] for i in wi], li).tolist(), strict=True):
                    if v >= 0.1:
                        mine = out.setdefault(part[x][1], {})
                        mine[y] = max(v, mine.get(y, 0.0))
        return out


class Reader:
    """The sentences of a text that hold words near a landmark: the largest value for each landmark, and how many such words."""

    def __init__(self, marks: Landmarks):
        self.marks, self.words, self.spelled = marks, {}, {}

    def _learn(self, new: list[str]) -> None:
        if len(self.words) > _CACHE_WORDS:
            self.words.clear()
        bare = list(map(_bare, new))
        found = self.marks(bare)
        for i, (w, b) in enumerate(zip(new, bare, strict=True)):
            self.words[w] = found.get(i, _SINGLE if len(b) == 1 else None)

    def sentences(self, texts: list[str]) -> Iterator[tuple[list[Sentence], int]]:
        """For each text its sentences, and the number of its words."""
        split = [t.lower().replace("\n", "\n ").split(" ") for t in texts]
        new = set().union(*split) if split else set()
        known = self.words
        if new := [w for w in new if w not in known]:
            self._learn(new)
            if missing := [w for w in set().union(*split) if w not in known]:
                self._learn(missing)
        for words in split:
            looked = list(map(known.__getitem__, words))
            active = [i for i, x in enumerate(looked) if x is not None]
            out: list[Sentence] = []
            if active:
                self._gather(words, looked, active, out)
            yield out, len(words)

    def _spelled(self, words: list[str], singles: list[int]) -> list[tuple[int, int, dict[int, float]]]:
        """First and last item and values of each run of single letters, with nothing but signs and spaces between them."""
        runs: list[list[int]] = []
        for i in singles:
            if runs and not any(_bare(w) for w in words[runs[-1][-1] + 1 : i]):
                runs[-1].append(i)
            else:
                runs.append([i])
        out = []
        for run in runs:
            if len(run) >= self.marks.p:
                joined = "".join(_bare(words[i]) for i in run)
                if joined not in self.spelled:
                    if len(self.spelled) > _CACHE_WORDS:
                        self.spelled.clear()
                    self.spelled[joined] = self.marks([joined]).get(0, {})
                out.append((run[0], run[-1], self.spelled[joined]))
        return out

    def _gather(self, words: list[str], looked: list, active: list[int], out: list[Sentence]) -> None:
        singles = [i for i in active if looked[i] is _SINGLE]
        found = self._spelled(words, singles) if len(singles) >= self.marks.p else []
        inside = {j for a, z, _ in found for j in range(a, z)}  # a stop within a run ends no sentence
        found += [(i, i, looked[i]) for i in active if looked[i] is not _SINGLE]
        current: dict[int, float] = {}
        last, count = -1, 0
        for a, z, values in sorted(found, key=lambda x: x[0]):
            if last >= 0 and any(_ends(words[j]) for j in range(last, a) if j not in inside):
                if current:
                    out.append((current, count))
                    current, count = {}, 0
            for k, v in values.items():
                if v > current.get(k, 0.0):
                    current[k] = v
            count += bool(values)
            last = z
        if current:
            out.append((current, count))


def _bare(word: str) -> str:
    return re.sub(r"[^\w]|_", "", word)


def _ends(word: str) -> bool:
    return not _ENDS.isdisjoint(word)


def candidates(rows: DataFrame, p: int, count: int) -> list[tuple[str, int, int]]:
    """(string, toxic, clean): the count strings at the start of words that best mark the toxic rows of rows (doc_id, text, y).

    Both numbers count rows of a label. A context (a word, the one before and the one after) belongs to the first row
    that has it, so copies of a passage count as one row. Only what may become a landmark reaches the driver.
    """
    bare = F.split(F.trim(F.regexp_replace(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}\s]+", ""), r"\s+", " ")), " ")
    words = rows.select("doc_id", "y", bare.alias("w")).select("doc_id", "y", F.explode(F.transform("w", lambda x, i: F.struct(x.alias("word"), F.xxhash64(x, F.get("w", i - 1), F.get("w", i + 1)).alias("near")))).alias("e"))
    seen = words.filter(F.length("e.word") >= p).groupBy("y", "e.word", "e.near").agg(F.min("doc_id").alias("row")).select("y", "word", "row").distinct()
    starts = seen.select("y", "row", F.explode(F.transform(F.sequence(F.lit(p), F.least(F.length("word"), F.lit(_LONGEST))), lambda k: F.substring(F.col("word"), F.lit(1), k))).alias("string"))
    total = starts.distinct().groupBy("string").agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("clean")).filter("toxic >= 3")
    got = total.orderBy(F.desc(F.col("toxic") - F.col("clean")), F.desc(F.length("string")), "string").limit(count).collect()
    return [tuple(r) for r in got]


def choose_landmarks(found: list[tuple[str, int, int]], n_toxic: int, n_clean: int, count: int, p: int, decay: float) -> list[str]:
    """Of candidates (string, toxic, clean) the best, one after another, each unlike those before it.

    A string's worth is what it marks in toxic rows less three times what the same share of clean rows would give.
    It must be three rows at least, and more than chance gives: half the root of the number of toxic rows.
    """
    ratio = n_toxic / max(1, n_clean)
    worth = {g: t - 3 * (c + 1) * ratio for g, t, c in found if t > 5 * (c + 1) * ratio}
    out: list[str] = []
    for g in sorted(worth, key=lambda g: (-worth[g], -len(g), g)):
        if len(out) == count or worth[g] < max(3, n_toxic**0.5 / 2):
            break
        if not any(g.startswith(x) or x.startswith(g) for x in out) and (not out or max(Landmarks(out, p, decay)([g]).get(0, {0: 0.0}).values()) < 0.5):
            out.append(g)
    return out


def _svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, steps: int = 200) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by accelerated gradient; the classes weigh alike."""
    w, b = np.zeros(x.shape[1]), 0.0
    s = np.where(y > 0, 1.0, -1.0)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum()))
    lip = 1e-3 / c + 2 * (weight[:, None] * (x * x + 0)).sum() + 2
    vw, vb = w.copy(), b
    for t in range(steps):
        slack = np.maximum(0, 1 - s * (x @ vw + vb))
        gw = 1e-3 / c * vw - 2 * (weight * slack * s) @ x
        gb = -2 * (weight * slack * s).sum()
        nw, nb = vw - gw / lip, vb - gb / lip
        m = t / (t + 3)
        vw, vb = nw + m * (nw - w), nb + m * (nb - b)
        w, b = nw, nb
    return w, b


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic curve over the columns of x and, last, its offset, by Newton's method with a small ridge."""
    z = np.column_stack([x, np.ones(len(x))])
    a = np.zeros(z.shape[1])
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((y <= 0).sum() + 2))
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(z @ a, -30, 30)))
        step = np.linalg.solve((z * (q * (1 - q))[:, None]).T @ z + 1e-4 * np.eye(len(a)), z.T @ (q - target) + 1e-4 * a)
        a -= step
        if np.abs(step).max() < 1e-8:
            break
    return a


def _document(worst: np.ndarray, hits: np.ndarray, words: np.ndarray) -> np.ndarray:
    """What a document is judged by: its worst sentence's margin, its words in sentences beyond the margin, their density."""
    return np.column_stack([worst, np.log1p(hits), np.log1p(100 * hits / np.maximum(words, 1))])


@dataclass
class ToxicityModel:
    marks: Landmarks
    weights: np.ndarray
    bias: float
    curve: np.ndarray
    prior: float

    def scores(self, read: list[tuple[list[Sentence], int]]) -> list[float]:
        """Scores of texts as a Reader gives them; a text without a word near a landmark has the bias as its margin."""
        if not len(self.weights):
            return [self.prior] * len(read)
        w, rows = self.weights.tolist(), []
        for sentences, words in read:
            margins = [self.bias + sum(w[k] * v for k, v in s.items()) for s, _ in sentences]
            rows.append((max(margins, default=self.bias), sum(n for m, (_, n) in zip(margins, sentences, strict=True) if m > 0), words))
        x = np.array(rows, float).reshape(len(rows), 3)
        z = _document(x[:, 0], x[:, 1], x[:, 2]) @ self.curve[:-1] + self.curve[-1]
        return (1 / (1 + np.exp(-np.clip(z, -30, 30)))).tolist()


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, per_class: tuple[int, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """text and y of at most per_class = (label 0, label 1) documents, those with the least hash of their id.

    An id that repeats in labels has its largest label; one that repeats in docs gives one row, its least text.
    """
    rows = labels.filter(usable & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_l"), F.col(label).cast("int").alias("_y")).groupBy("_l").agg(F.max("_y").alias("_y"))
    picked = [rows.filter(F.col("_y") == y).orderBy(F.xxhash64("_l"), "_l").limit(n) for y, n in enumerate(per_class)]
    sample = F.broadcast(picked[0].unionByName(picked[1]))  # at most sum(per_class) ids
    got = docs.select(F.col(id_col).alias("_l"), F.coalesce(F.col(text_col), F.lit("")).alias("_t")).join(sample, "_l")
    return staged(got.groupBy("_l").agg(F.min("_t").alias("text"), F.first("_y").alias("y")), "labelled").select(F.col("_l").alias("doc_id"), "text", "y")


def _witnesses(rows: DataFrame, marks: Landmarks) -> DataFrame:
    """doc_id, its sentences near a landmark (a value v for each landmark, and n words) and its words, for each of rows (doc_id, text)."""
    shared = rows.sparkSession.sparkContext.broadcast(marks)

    def make():
        reader, m = _reader(shared.value), len(shared.value.strings)

        def of(texts: list[str]) -> list:
            read = list(reader.sentences(texts))
            return [[[{"v": [s.get(k, 0.0) for k in range(m)], "n": n} for s, n in found] for found, _ in read], [n for _, n in read]]

        return of

    return per_text(rows, "sentences array<struct<v:array<double>,n:int>>, words int", make)


def train(rows: DataFrame, *, landmarks: int = 48, candidate_strings: int = 512, p: int = 4, decay: float = 0.6, rounds: int = 3) -> ToxicityModel:
    """A model of rows (doc_id, text, y).

    Texts stay with the workers: the driver gets candidate_strings strings and, in each round, one row of landmark
    values and a label for each row. Without rows of both labels, or strings that tell them apart, the model has no
    landmark and scores every text with the share of toxic rows, 0 where there are none.
    """
    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    strings = choose_landmarks(candidates(rows, p, candidate_strings), n[1], n[0], landmarks, p, decay) if len(n) == 2 else []
    marks = Landmarks(strings, p, decay)
    m = len(strings)
    if not m:
        return ToxicityModel(marks, np.zeros(0), 0.0, np.zeros(0), n.get(1, 0) / max(1, sum(n.values())))
    read = staged(_witnesses(rows, marks).join(rows.select("doc_id", "y"), "doc_id"), "witnesses")

    def judged(w: np.ndarray, b: float) -> tuple[np.ndarray, ...]:
        """Each row's worst sentence, its label, its words in sentences beyond the margin, and all its words."""
        margin = lambda s: F.aggregate(F.zip_with(s["v"], F.lit(w.tolist()), lambda x, y: x * y), F.lit(float(b)), lambda x, y: x + y)
        worst = F.array_max(F.transform("sentences", lambda s: F.struct(margin(s).alias("m"), s["v"].alias("v"))))["v"]
        hits = F.aggregate(F.transform("sentences", lambda s: F.when(margin(s) > 0, s["n"]).otherwise(0)), F.lit(0), lambda x, y: x + y)
        got = sorted(tuple(r) for r in read.select("doc_id", "y", worst, hits, "words").collect())
        return np.array([r[2] or [0.0] * m for r in got]), *(np.array([r[k] for r in got], float) for k in (1, 3, 4))

    w, b = np.ones(m), 0.0
    for _ in range(rounds):
        x, y, _, _ = judged(w, b)
        u, b = _svm(x @ marks.nystrom, y)
        w = marks.nystrom @ u
    x, y, hits, words = judged(w, b)
    return ToxicityModel(marks, w, b, _logistic(_document(b + x @ w, hits, words), y), 0.0)


def _reader(marks: Landmarks) -> Reader:
    return held("toxicity", (tuple(marks.strings), marks.p, marks.decay), lambda: Reader(marks))


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) for each row of docs. Null texts count as empty; equal texts score alike."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        reader = _reader(shared.value.marks)
        return lambda texts: [shared.value.scores(list(reader.sentences(texts)))]

    return per_text(docs, "score double", make, id_col, text_col)


def bucket(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_id.cast("string")) % folds


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, per_class: tuple[int, int] = (4500, 1500), id_col: str = "doc_id", text_col: str = "text", **options) -> ToxicityModel:
    """A model of labels.toxic, from rows whose crc32(doc_id) mod 4 is not 2, at most per_class of either label."""
    ship(docs.sparkSession)
    return train(labelled_sample(docs, labels, "toxic", bucket(F.col("doc_id"), 4) != 2, per_class, id_col, text_col), **options)


def classify(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, **options) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs.

    Null and empty texts score as texts without an insult. Texts are read whole, whatever their length. Rows that
    repeat each give their row, and equal texts score alike; a null id has held_out null. Without usable labels of
    both kinds all rows score alike, 0 where there are none. An empty table gives an empty result. Other columns of
    docs are ignored.
    """
    out = score(docs, fit_toxicity(docs, labels, **options))
    return out.select("doc_id", (bucket(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, all columns as they were, but for those with a word near a landmark that score threshold or more.

    Without such a word there is no evidence, so the row stays: null, empty and blank texts, and all rows where labels
    don't allow a model. Rows that repeat share their fate; ids may be null or repeat; no order is kept. Texts are
    read whole. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit_toxicity(docs, labels, id_col=id_col, text_col=text_col, **options))
    at_text = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(shared.value.marks)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                read = list(reader.sentences([t or "" for t in part.column(at_text).to_pylist()]))
                stays = [not found or x < threshold for (found, _), x in zip(read, shared.value.scores(read), strict=True)]
                yield part.filter(pa.array(stays, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
