"""Toxicity scores from class-conditional Kneser-Ney character models.

Words are read character by character with four characters of context. Each class (toxic, ordinary) has its own
counts at the highest order; both back off to one shared lower-order distribution of Kneser-Ney continuation counts,
gathered over all documents, so that a rare expression is judged by its spelling; what neither class has seen counts alike.
A document is compared by its length-normalised log-likelihoods, the mean difference per character over the whole text, and by the
mean difference of its one, three and eight most toxic words (an expression that ordinary texts use now and then tells less
when it stands alone). They go through a logistic calibration.

The corpus's grams stay in a stored table, whole and unhashed, which grows with the input; continuation counts are
aggregated and joined there. Two classes can only differ on grams that labelled documents have shown, so just those, each with its
finished log-ratio, are sent to the workers. They come from at most `train_rows` labelled documents (chosen by hash), halved until
their distinct grams are at most `most_grams`: both are documented bounds of the sample, and of what is broadcast (12 bytes a gram).

Rows whose crc32(doc_id as text) mod 5 is 0 are held out: neither counts of a class nor the calibration see them.
Defined results: null or empty texts have no words and get the calibrated score of no evidence; a null doc_id is not
held out; without usable labels of both classes every score is 0.0; a document with several labels is toxic if one of them says so;
repeated rows are scored each; an empty table gives no rows. Very long texts are scored whole, a slice of rows at a time. Extra columns are
kept by score_documents() unless their names clash with the operator's, which win.
"""

from __future__ import annotations

import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from gridlake.llm.common import keep, light, mix64, scratch, slices, stored, tidy

ORDER = 5  # characters of a gram; the last one is predicted
BITS = 21  # of a code point; hi holds a gram's first two characters, lo the last three
DISCOUNT = 0.75
TRAIN_ROWS = 20_000
MOST_GRAMS = 4_000_000
CACHE_WORDS = 200_000
FLUSH_WORDS = 150_000
TOP = (1, 3, 8)  # most toxic words of a text that are looked at together
FEATURES = ("mean", *(f"top{k}" for k in TOP), "chars")
START, END = 2, 3
MASK = (1 << BITS) - 1


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _letters(chunk: str) -> str:
    """The chunk's inner text: what is left without marks at its ends."""
    start, end = 0, len(chunk)
    while start < end and not chunk[start].isalnum():
        start += 1
    while end > start and not chunk[end - 1].isalnum():
        end -= 1
    return chunk[start:end].lower()


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """hi and lo of the words' ORDER-grams, one for each character and the end, and where each word's grams start."""
    if not words:
        return (np.zeros(0, np.int64),) * 3
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    text = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    pad = ORDER - 1
    starts = np.concatenate([[0], np.cumsum(lengths + pad + 1)[:-1]])
    codes = np.full(int((lengths + pad + 1).sum()), START, np.int64)
    inside = np.ones(len(codes), bool)
    for k in range(pad):
        inside[starts + k] = False
    codes[starts + pad + lengths] = END
    predicted = inside[pad:].copy()
    inside[starts + pad + lengths] = False
    codes[inside] = np.maximum(text, END + 1)
    a, b, c, d, e = (codes[k : len(codes) - pad + k] for k in range(ORDER))
    begin = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    return (a << BITS | b)[predicted], (c << 2 * BITS | d << BITS | e)[predicted], begin


def _key(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    return mix64(lo.view(np.uint64) ^ mix64(hi.view(np.uint64)))


def _distinct(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (hi, lo), and which of them each row is."""
    order = np.lexsort((lo, hi))
    hi, lo = hi[order], lo[order]
    new = np.concatenate([[True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])])[: len(hi)]
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    return hi[new], lo[new], which


@light
def _corpus_task(batches):
    """(hi, lo) of the texts' words, each now and then again."""
    seen: set[str] = set()

    def flush():
        hi, lo, _ = _grams(sorted({_letters(c) for c in seen} - {""}))
        seen.clear()
        return pa.RecordBatch.from_arrays([pa.array(x) for x in _distinct(hi, lo)[:2]], names=["hi", "lo"])

    for batch in slices(batches):
        for text in batch.column("text").to_pylist():
            if text:
                seen.update(text.split())
            if len(seen) >= FLUSH_WORDS:
                yield flush()
    if seen:
        yield flush()


@light
def _class_task(batches):
    """(hi, lo, t, o) of the labelled texts: documents that each word stands in, toxic and ordinary."""
    seen = (Counter(), Counter())
    for batch in slices(batches):
        for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist()):
            seen[toxic == 0].update({_letters(c) for c in set((text or "").split())} - {""})
    words = sorted(seen[0].keys() | seen[1].keys())
    hi, lo, begin = _grams(words)
    sizes = np.diff(np.append(begin, len(hi)))
    hi, lo, which = _distinct(hi, lo)
    counts = (np.bincount(which, np.repeat(np.fromiter((n[w] for w in words), np.float64, len(words)), sizes), len(hi)).astype(np.int64) for n in seen)
    if words:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (hi, lo, *counts)], names=["hi", "lo", "t", "o"])


def _level(n: Column, total: Column, types: Column, lower: Column) -> Column:
    """Absolute discounting: what is seen less the discount, and what was taken off dealt out by the lower order."""
    top = F.greatest(n - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.greatest(types, F.lit(1)) * lower
    return F.when(total > 0, top / F.greatest(total, n)).otherwise(lower)


def log_ratios(corpus: DataFrame, classes: DataFrame) -> DataFrame:
    """(hi, lo, ratio): log P(toxic) - log P(ordinary) of the last character of each gram in classes (hi, lo, t, o).

    corpus holds the distinct grams of all documents, those of classes among them."""
    hi, lo = F.col("hi"), F.col("lo")
    #: key of the last k characters of a gram, and of the k - 1 before the last
    key = {4: F.struct(hi.bitwiseAND(F.lit(MASK)).alias("hi"), lo), 3: lo, 2: lo.bitwiseAND(F.lit((1 << 2 * BITS) - 1)), 1: lo.bitwiseAND(F.lit(MASK))}
    before = {4: F.struct(hi.bitwiseAND(F.lit(MASK)).alias("hi"), F.shiftright(lo, BITS).alias("lo")), 3: F.shiftright(lo, BITS), 2: F.shiftright(key[2], BITS), 1: F.lit(0).cast("long")}
    context = classes.groupBy("hi", F.shiftright(lo, BITS).alias("c")).agg(
        *(F.sum(x).alias("c" + x) for x in "to"), *(F.sum((F.col(x) > 0).cast("long")).alias("k" + x) for x in "to")
    )
    found = classes.withColumn("c", F.shiftright(lo, BITS)).join(context, ["hi", "c"]).drop("c")
    shared, level = None, corpus.select("hi", "lo")
    for k in (4, 3, 2, 1):
        level = level.groupBy(key[k].alias("key")).agg(F.count("*").alias(f"m{k}"), F.first(before[k]).alias("before"))
        totals = level.groupBy("before").agg(F.sum(f"m{k}").alias(f"s{k}"), F.count("*").alias(f"y{k}"))
        found = found.withColumn("key", key[k]).join(level.drop("before"), "key").drop("key")
        found = found.withColumn("before", before[k]).join(totals, "before").drop("before")
        rest = F.col("key.hi"), F.col("key.lo")
        level = level.select(*(rest if k == 4 else (F.lit(0).cast("long").alias("hi"), F.col("key").alias("lo"))))
    for k in (1, 2, 3, 4):
        m, s, y = (F.col(f"{x}{k}") for x in "msy")
        shared = (m + 1) / (s + y + 1) if shared is None else _level(m, s, y, shared)
    toxic, ordinary = (_level(F.col(x), F.col("c" + x), F.col("k" + x), F.col("shared")) for x in "to")
    return found.withColumn("shared", shared).select("hi", "lo", (F.ln(toxic) - F.ln(ordinary)).cast("float").alias("ratio"))


class Scorer:
    """Log-likelihood differences of words, from the grams' ratios; other grams count alike in both classes."""

    def __init__(self, hi: np.ndarray, lo: np.ndarray, ratio: np.ndarray):
        keys = _key(hi, lo)
        order = np.argsort(keys)
        self.keys, self.ratio = keys[order], ratio[order]
        self._empty()

    def _empty(self) -> None:
        self.known: dict[str, int] = {}
        self.value, self.size = np.zeros(0), np.zeros(0)

    def words(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Summed log-likelihood difference and predicted characters of each word; none for an empty one."""
        hi, lo, begin = _grams(names)
        differ = np.zeros(len(hi) + 1)
        if len(hi) and len(self.keys):
            keys = _key(hi, lo)
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            differ[:-1] = np.where(self.keys[at] == keys, self.ratio[at], 0)
        size = np.array([len(w) + 1 if w else 0 for w in names], float)
        return np.where(size > 0, np.add.reduceat(differ, begin) if names else 0, 0), size

    def documents(self, texts: list[str | None]) -> np.ndarray:
        """FEATURES of each text: mean difference per character, means of the words' largest differences, characters."""
        split = [(t or "").split() for t in texts]
        new = {c for chunks in split for c in chunks if c not in self.known}
        if len(self.known) > CACHE_WORDS:
            self._empty()
            new = {c for chunks in split for c in chunks}
        if new:
            value, size = self.words([_letters(c) for c in new])
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.value, self.size = np.concatenate([self.value, value]), np.concatenate([self.size, size])
        out = np.zeros((len(texts), len(FEATURES)))
        for i, chunks in enumerate(split):
            if chunks:
                rows = np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))
                value, chars = self.value[rows], self.size[rows].sum()
                most = np.partition(value, len(value) - TOP[-1])[-TOP[-1] :] if len(value) > TOP[-1] else value
                most = np.sort(np.maximum(most, 0))[::-1]
                out[i] = value.sum() / max(chars, 1), *(most[:k].sum() / k for k in TOP), chars
        return out


def _scorer(broadcast, model_id: str) -> Scorer:
    """One scorer in a Python worker; its word cache outlives a task."""
    return keep(("toxicity", model_id), lambda: Scorer(*broadcast.value))


def features_of(found: np.ndarray) -> np.ndarray:
    mean, one, *more, chars = found.T
    return np.column_stack([np.ones(len(mean)), np.clip(mean, -1, 1) * 10, one / 10, *(x / 5 for x in more), np.log1p(chars) / 10])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Newton's method for a ridge-regularised logistic regression."""
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1]) * 0.01
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, most_grams: int = MOST_GRAMS):
    """(broadcast ratios, their id, weights of the calibration), or None if the labels don't hold both classes."""
    spark = docs.sparkSession
    usable = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    each = usable.groupBy("doc_id").agg(F.max((F.col("toxic") != 0).cast("int")).alias("toxic"))
    chosen = each.withColumn("part", (F.crc32(F.col("doc_id").cast("string")) % 5).cast("int")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    chosen = chosen.toArrow()  # at most train_rows rows
    if len(chosen.column("toxic").unique()) < 2:
        return None
    texts = docs.select("doc_id", "text")
    rows = min(train_rows, chosen.num_rows)
    while True:  # the sample shrinks until its grams fit what is broadcast
        sample = spark.createDataFrame(chosen.slice(0, rows))
        labelled = texts.join(F.broadcast(sample), "doc_id")
        counted = labelled.where("part <> 4").select("text", "toxic").mapInArrow(_class_task, "hi long, lo long, t long, o long")
        classes = stored(counted.groupBy("hi", "lo").agg(F.sum("t").alias("t"), F.sum("o").alias("o")), "toxicity-classes")
        if rows == 1 or classes.count() <= most_grams:
            break
        rows //= 2
    corpus = stored(texts.select("text").mapInArrow(_corpus_task, "hi long, lo long").distinct(), "toxicity-corpus")
    ratios = log_ratios(corpus, classes).toArrow()
    model = tuple(ratios.column(c).to_numpy() for c in ("hi", "lo", "ratio"))
    shared, model_id = spark.sparkContext.broadcast(model), uuid.uuid4().hex

    def features(batches):
        scorer = _scorer(shared, model_id)
        for batch in slices(batches):
            found = scorer.documents(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *(pa.array(x) for x in found.T.copy())], names=["y", *FEATURES])

    checks = labelled.where("part = 4").select("text", "toxic")
    found = checks.mapInArrow(features, "y int, " + ", ".join(f"{c} double" for c in FEATURES)).toArrow()  # at most train_rows labels
    x = np.column_stack([found.column(c).to_numpy() for c in FEATURES])
    y = found.column("y").to_numpy()
    if len(set(y.tolist())) < 2:
        return shared, model_id, np.array([-2.0, 1.0, *([1.0] * len(TOP)), 0.0])
    return shared, model_id, fit_logistic(features_of(x), y.astype(float))


def score_documents(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, most_grams: int = MOST_GRAMS) -> DataFrame:
    """docs with held_out boolean, score double and predicted int."""
    with scratch(docs.sparkSession):
        fitted = fit(docs, labels, train_rows, most_grams)
    kept = docs.drop("held_out", "score", "predicted")
    if fitted is None:
        scored = kept.withColumn("score", F.lit(0.0))
    else:
        shared, model_id, weights = fitted

        def score(batches):
            scorer = _scorer(shared, model_id)
            for batch in slices(batches):
                found = scorer.documents(batch.column("text").to_pylist())
                value = 1 / (1 + np.exp(-np.clip(features_of(found) @ weights, -30, 30)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value)], names=[*batch.schema.names, "score"])
            tidy()

        scored = kept.mapInArrow(score, StructType([*kept.schema.fields]).add("score", DoubleType()))
    return scored.withColumn("held_out", held_out(F.col("doc_id"))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_documents(docs.select("doc_id", "text"), labels.select("doc_id", "toxic")).select("doc_id", "held_out", "score", "predicted")
