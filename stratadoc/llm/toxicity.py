r"""Toxicity: a convolutional text classifier trained in numpy.

A word's embedding is the sum of hashed embeddings of the word and of its first
3 to 6 characters, so that inflected forms share most of it. Filters of widths
1 to 3 run over the words of a text; each filter's largest response in the whole
text, through a rectifier, goes into a logistic output. A threshold is
calibrated for each language by cross-validation, on outputs of models that were
not fitted to the row; the language is guessed from function words of the text
itself. A score is the
logistic of the output less the threshold, so 0.5 is each language's threshold.

Labels are learned from rows whose crc32(doc_id as text) mod 5 is not 0, at most
``SAMPLE`` rows of either label and of at most ``SAMPLE_CHARS`` characters each,
chosen by a hash of the id. Labels, ids, languages and sources of the table are
never inputs of a score. All texts are scored whole.

Defined results: null and empty texts have no words and get the score that the
biases give; labels that are null, and labelled ids without a document, are left
out; of repeated labels the largest counts; with labels of one kind or none the
score is that of an untrained output with the labels' share as its prior;
repeated rows each get their row; columns beside those named are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratadoc.llm._shared import bound_batches, chunks, kept, table, task

#: Labelled rows of either label at most, and their length: the bound of the sample.
SAMPLE, SAMPLE_CHARS = 2000, 20_000
FOLDS = 5
WIDTHS, FILTERS, DIM, BUCKETS = (1, 2, 3), 8, 16, 1 << 15
PREFIXES = (3, 4, 5, 6)
EPOCHS, BATCH, RATE, EMBED_RATE, DECAY = 8, 32, 0.005, 5.0, 1e-4
#: Deviation of the first embeddings: small, so that words never met say little.
SPREAD = 0.005
#: Parts of the sample that are left out in turn for the thresholds.
HOLD = 3
#: Rows of the rarer label by which a language's threshold is drawn to the common one.
PULL = 8
#: Characters scored together, and words whose hashes a worker keeps.
CHUNK, MOST_WORDS = 1 << 20, 150_000
# Function words by language.
FUNCTION_WORDS = {
    "en": "the of and to that in is was with for this are",
    "fr": "le les des une un et est dans pour que sur pas",
    "de": "der die das und ist den von mit ein eine nicht auf",
    "es": "el los las una que del por con para es como su",
}
LANGUAGES = (*FUNCTION_WORDS, "other")
_words = re.compile(r"[^\W_]+").findall
_function = {w: [i for i, (k, v) in enumerate(FUNCTION_WORDS.items()) if w in v.split()] for v in FUNCTION_WORDS.values() for w in v.split()}


class Words:
    """Numbers words and keeps what is hashed of each; number 0 is padding."""

    def __init__(self, most: int = MOST_WORDS):
        self.most = most
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        self.hashes = np.full((1024, 1 + len(PREFIXES)), BUCKETS, np.int32)
        self.languages = np.zeros((1024, len(FUNCTION_WORDS)), np.float32)

    def _add(self, word: str) -> int:
        n = self.number[word] = len(self.number) + 1
        if n >= len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.full_like(self.hashes, BUCKETS)])
            self.languages = np.concatenate([self.languages, np.zeros_like(self.languages)])
        row = [zlib.crc32(word.encode()) % BUCKETS]
        row += [zlib.crc32(("^" + word[:k]).encode()) % BUCKETS for k in PREFIXES if len(word) > k]
        self.hashes[n, : len(row)] = row
        for i in _function.get(word, ()):
            self.languages[n, i] = 1
        return n

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words of all texts, each between paddings, and where each text begins."""
        if len(self.number) > self.most:
            self._clear()
        get, add = self.number.get, self._add
        pad = max(WIDTHS) - 1
        out, starts = [0] * pad, []
        for t in texts:
            starts.append(len(out) - pad)
            out += [get(w) or add(w) for w in _words(t.lower())]
            out += [0] * pad
        return np.array(out, np.int64), np.array(starts, np.int64)


class Model:
    """Weights, and the thresholds (of the output before the logistic) by language."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.embed = np.zeros((BUCKETS + 1, DIM), np.float32)
        self.embed[:BUCKETS] = r.normal(0, SPREAD, (BUCKETS, DIM))
        self.filters = [r.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = np.abs(r.normal(0, 0.3, len(WIDTHS) * FILTERS)).astype(np.float32) * np.where(np.arange(len(WIDTHS) * FILTERS) % 4, 1, -1).astype(np.float32)
        self.prior = np.zeros(1, np.float32)
        self.thresholds = np.zeros(len(LANGUAGES), np.float32)

    def responses(self, ids: np.ndarray, hashes: np.ndarray):
        """Responses of each width's filters at each place that a window of it can start."""
        used, at = np.unique(ids, return_inverse=True)
        rows = hashes[used]
        vectors = self.embed[rows[:, 0]]
        for k in range(1, rows.shape[1]):
            vectors += self.embed[rows[:, k]]
        out = []
        for w, f in zip(WIDTHS, self.filters):
            n = len(ids) - w + 1
            h = (vectors @ f[0])[at[:n]]
            for k in range(1, w):
                h += (vectors @ f[k])[at[k : k + n]]
            out.append(h)
        return used, at, vectors, out

    @staticmethod
    def windows(starts: np.ndarray, total: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Where each text's windows begin and end; those of a width may reach into the paddings."""
        pad = max(WIDTHS) - 1
        first = starts + pad - (width - 1)
        last = np.append(starts[1:] + pad, total) - pad
        return first, np.maximum(last, first + 1)

    def output(self, ids, starts, hashes) -> np.ndarray:
        *_, responses = self.responses(ids, hashes)
        pooled = []
        for w, h in zip(WIDTHS, responses):
            first, last = self.windows(starts, len(ids), w)
            last = np.minimum(last, len(h))
            edges = np.stack([first, last], 1).ravel()
            padded = np.concatenate([h, np.full((1, h.shape[1]), -np.inf, h.dtype)])
            pooled.append(np.maximum.reduceat(padded, edges, axis=0)[::2])
        hidden = np.maximum(np.concatenate(pooled, 1) + self.bias, 0)
        return hidden @ self.out + self.prior

    def step(self, ids, starts, hashes, target, weight):
        """Gradients of the weighted logistic loss over one batch; that of the embeddings as the rows that each gradient is for."""
        used, at, vectors, responses = self.responses(ids, hashes)
        places, pooled = [], []
        for w, h in zip(WIDTHS, responses):
            first, last = self.windows(starts, len(ids), w)
            best = np.stack([a + h[a:b].argmax(0) for a, b in zip(first, np.minimum(last, len(h)))])
            places.append(best)
            pooled.append(np.take_along_axis(h, best, 0))
        pre = np.concatenate(pooled, 1) + self.bias
        hidden = np.maximum(pre, 0)
        p = 1 / (1 + np.exp(-(hidden @ self.out + self.prior)))
        d = ((p - target) * weight / len(target)).astype(np.float32)
        grads = {"out": hidden.T @ d, "prior": np.array([d.sum()], np.float32)}
        dh = d[:, None] * self.out * (pre > 0)
        grads["bias"] = dh.sum(0)
        dv = np.zeros_like(vectors)
        grads["filters"] = []
        for i, (w, f) in enumerate(zip(WIDTHS, self.filters)):
            g = dh[:, i * FILTERS : (i + 1) * FILTERS]
            df = np.zeros_like(f)
            for k in range(w):
                rows = at[places[i] + k]
                df[k] = np.einsum("bfd,bf->df", vectors[rows], g)
                np.add.at(dv, rows, g[:, :, None] * f[k].T[None])
            grads["filters"].append(df)
        some = np.flatnonzero(dv.any(1))  # only the words of the largest responses
        grads["embed"] = hashes[used[some]], dv[some]
        return grads


def languages(ids, starts, words: Words) -> np.ndarray:
    """The language whose function words are most frequent in each text; the last one if there are none."""
    if not len(starts):
        return np.zeros(0, np.int64)
    counts = np.add.reduceat(words.languages[ids], starts, axis=0)
    return np.where(counts.max(1) > 0, counts.argmax(1), len(LANGUAGES) - 1)


def batch(each: list[np.ndarray], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """These texts' words end to end, and where each begins."""
    pad = max(WIDTHS) - 1
    ids = np.concatenate([each[rows[0]][:pad], *[each[i][pad:] for i in rows]])
    return ids, np.concatenate([[0], np.cumsum([len(each[i]) - pad for i in rows])[:-1]])


def optimised(each: list[np.ndarray], labels: np.ndarray, train: np.ndarray, hashes: np.ndarray, seed: int) -> Model:
    """A model of the rows ``train``, by Adam."""
    model, r, train = Model(seed), np.random.default_rng(seed), train.copy()
    share = labels[train].mean()
    params = {"bias": model.bias, "out": model.out, "prior": model.prior} | {f"filter{i}": f for i, f in enumerate(model.filters)}
    first = {k: np.zeros_like(v) for k, v in params.items()}
    second = {k: np.zeros_like(v) for k, v in params.items()}
    epochs, t = max(EPOCHS, -(-400 * BATCH // len(train))), 0
    for _ in range(epochs):
        r.shuffle(train)
        for i in range(0, len(train), BATCH):
            rows = train[i : i + BATCH]
            y = labels[rows]
            g = model.step(*batch(each, rows), hashes, y, np.where(y > 0, 0.5 / share, 0.5 / (1 - share)))
            g |= {f"filter{j}": x for j, x in enumerate(g.pop("filters"))}
            t += 1
            rows, grad = g.pop("embed")
            model.embed *= 1 - EMBED_RATE * DECAY
            np.subtract.at(model.embed, rows, (EMBED_RATE * grad)[:, None, :])
            model.embed[BUCKETS] = 0
            for k, v in params.items():
                grad = g[k]
                first[k] += 0.1 * (grad - first[k])
                second[k] += 0.001 * (grad * grad - second[k])
                v -= RATE * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    return model


def outputs(model: Model, each: list[np.ndarray], rows: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The model's outputs and the guessed languages of these rows."""
    z, lang = [np.zeros(0)], [np.zeros(0, np.int64)]
    for i in range(0, len(rows), 256):
        ids, starts = batch(each, rows[i : i + 256])
        z.append(model.output(ids, starts, words.hashes))
        lang.append(languages(ids, starts, words))
    return np.concatenate(z), np.concatenate(lang)


def fit(texts: list[str], labels: np.ndarray, seed: int = 7) -> Model:
    """Trains on these texts; the thresholds are set on outputs of models that have not seen the text, as ``HOLD`` parts are left out in turn."""
    words = Words(1 << 60)
    labels = np.asarray(labels, np.float32)
    if not len(texts) or labels.min() == labels.max():
        model, share = Model(seed), float(labels.mean()) if len(texts) else 0.0
        model.out[:] = 0
        model.prior[:] = np.log((share * len(texts) + 0.5) / ((1 - share) * len(texts) + 1.5))
        return model
    each = [words.read([t])[0] for t in texts]
    order = np.random.default_rng(seed).permutation(len(texts))
    order = order[np.argsort(labels[order], kind="stable")]  # so that the parts have alike shares of either label
    z, lang = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    seen = np.zeros(len(texts), bool)
    for k in range(HOLD):
        held, train = order[k::HOLD], np.delete(order, np.s_[k::HOLD])
        if len(held) and labels[train].min() < labels[train].max():
            z[held], lang[held] = outputs(optimised(each, labels, train, words.hashes, seed + 1 + k), each, held, words)
            seen[held] = True
    model = optimised(each, labels, order, words.hashes, seed)
    model.thresholds[:] = calibrated(z[seen], labels[seen], lang[seen])
    return model


def calibrated(z: np.ndarray, y: np.ndarray, lang: np.ndarray) -> np.ndarray:
    """The threshold of each language: its own, drawn towards that of all by the weight of ``PULL`` rows."""
    everywhere = threshold(z, y)
    out = np.full(len(LANGUAGES), everywhere, np.float32)
    for k in range(len(LANGUAGES)):
        rows = lang == k
        n = min((y[rows] > 0).sum(), (y[rows] == 0).sum())
        if n:
            out[k] = (n * threshold(z[rows], y[rows]) + PULL * everywhere) / (n + PULL)
    return out


def threshold(z: np.ndarray, y: np.ndarray) -> float:
    """The middle of the widest range of outputs that gives the least sum of the two error rates."""
    if not len(y) or y.min() == y.max():
        return 0.0
    order = np.argsort(z, kind="stable")
    z, y = z[order], y[order]
    missed = np.append(0, np.cumsum(y > 0)) / (y > 0).sum()
    false = 1 - np.append(0, np.cumsum(y == 0)) / (y == 0).sum()
    edges = np.concatenate([[z[0] - 2], z, [z[-1] + 2]])
    width = np.diff(edges)
    best = np.lexsort((-width, np.round(missed + false, 9)))[0]
    return float((edges[best] + edges[best + 1]) / 2)


def sample(docs: DataFrame, labels: DataFrame) -> tuple[list[str], np.ndarray]:
    """The bounded sample of labelled texts: ids first, from the narrow table, then their texts."""
    ids = (
        labels.filter("doc_id is not null and toxic is not null").filter(~held_out())
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("place", F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("/toxic"))))
    )
    chosen = [ids.filter(c).orderBy("place", "doc_id").limit(SAMPLE) for c in ("toxic > 0", "toxic <= 0")]
    chosen = F.broadcast(chosen[0].unionByName(chosen[1]).select("doc_id", "toxic"))
    texts = docs.select("doc_id", "text").filter(F.length(F.coalesce("text", F.lit(""))) <= SAMPLE_CHARS)
    rows = texts.join(chosen, "doc_id").groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.max("toxic").alias("toxic")).toPandas().sort_values("doc_id")
    return rows["text"].tolist(), (rows["toxic"].to_numpy() > 0).astype(np.float32)


def held_out():
    return (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS) == 0


def train(docs: DataFrame, labels: DataFrame) -> Model:
    return fit(*sample(docs, labels))


def _score(model):
    @task("toxicity")
    def run(batches):
        m = model.value
        tables = kept("toxicity")
        if "words" not in tables:
            tables["words"] = Words()
        words = tables["words"]
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            scores, langs = [], []
            for a, b in chunks(texts, CHUNK):
                ids, starts = words.read(texts[a:b])
                lang = languages(ids, starts, words)
                z = m.output(ids, starts, words.hashes) - m.thresholds[lang]
                scores.append(1 / (1 + np.exp(-z.astype(np.float64))))
                langs += [LANGUAGES[k] for k in lang]
            score = pa.array(np.concatenate(scores) if scores else np.zeros(0))
            yield pa.RecordBatch.from_arrays([batch.column(0), score, pa.array(langs, pa.string())], names=[batch.schema.names[0], "score", "language"])

    return run


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, score and the guessed language."""
    bound_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_score(shipped), "doc_id long, score double, language string")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without those that score 0.5 and more; all columns as they were."""
    bound_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))
    kind = row.schema["row"].dataType.simpleString()
    kept = row.mapInArrow(_score(shipped), f"row {kind}, score double, language string").filter("score < 0.5")
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = scored(docs, train(docs, table(spark, sf_dir, "labels")))
    return rows.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "language")
