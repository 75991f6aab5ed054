"""Toxicity: a convolutional text classifier with max pooling.

A word's embedding is the sum of two rows of a table, found by two hashes, so two
words look alike only if both hashes clash.  Filters of several widths run over
the embeddings, each keeps its largest answer in the text (so one insult in a
very long text counts as much as in a short one), and a logistic unit reads the
answers.  The model is trained in numpy on a bounded sample of labelled rows in
one task, and has a fixed size.

Thresholds are calibrated by language on a part of the sample that the weights
never saw; a score itself depends on the text alone.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rookery.llm.common import slices, utf8
from rookery.llm.decontaminate import words_of
from rookery.llm.labelled import SAMPLE_ROWS, WordHashes, held_out, labelled_sample

#: Rows of the embedding table, and numbers in a row.
BUCKETS, DIMS = 1 << 17, 8
#: Filter widths in words, and filters of each.
WIDTHS, FILTERS = (1, 2, 3), 8
EPOCHS, BATCH, RATE = 4, 32, 0.02
#: Words that a forward step holds at once, or one document.
STEP_WORDS = 400_000
#: Part of the sample that calibrates thresholds: one row in this many.
CALIBRATION = 5
#: Fewest calibration rows of each class for a language to have its own threshold.
LEAST = 10
#: Errors on the calibration rows that a threshold has to save for each unit of log odds away from the default.
PULL = 1.0
#: Score from which label 1 is predicted, and the threshold of other languages.
THRESHOLD = 0.3

PAD = max(WIDTHS) - 1


def buckets(texts: list[bytes], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two bucket numbers for each word, documents apart by ``PAD`` empty places, and where each begins.

    Bucket 0 is empty and stays zero.
    """
    parts, begins, at = [], [], 0
    gap = np.zeros(PAD + 1, np.int64)
    for text in texts:
        h = hashes.of(words_of(text)).astype(np.int64) + 1
        begins.append(at)
        at += len(h) + len(gap)
        parts += [h, gap]
    h = np.concatenate(parts) if parts else gap[:0]
    mixed = h * 0x2545F4914F6CDD1D
    one = np.where(h > 0, 1 + ((mixed >> 20) & 0x7FFFFFFF) % (BUCKETS - 1), 0)
    two = np.where(h > 0, 1 + ((mixed >> 33 ^ h * 0x9E3779B1) & 0x7FFFFFFF) % (BUCKETS - 1), 0)
    return one, two, np.array(begins, np.int64)


class Network:
    def __init__(self, seed: int = 0) -> None:
        r = np.random.default_rng(seed)
        self.table = np.zeros((BUCKETS, DIMS), np.float32)
        self.filters = [r.normal(0, 0.3, (w, DIMS, FILTERS)).astype(np.float32) for w in WIDTHS]
        for f in self.filters:  # half of the filters start by reading the first number, the class's log odds
            f[:, 0, : FILTERS // 2] = 1.0 / len(f)
        self.shift = np.zeros((len(WIDTHS), FILTERS), np.float32)
        self.out = r.normal(0, 0.1, len(WIDTHS) * FILTERS).astype(np.float32)
        self.bias = np.float32(-1.0)

    def pooled(self, one: np.ndarray, two: np.ndarray, begins: np.ndarray, where: bool = False):
        """Largest answer of every filter in every document, not below 0; with ``where``, also its place."""
        e = self.table[one] + self.table[two]
        n = len(e)
        ends = np.append(begins[1:], n) - PAD  # a filter that starts later would see the next document
        spans = np.stack([begins, ends], axis=1).ravel()
        best, places = [], []
        for f, shift in zip(self.filters, self.shift, strict=True):
            conv = e @ f[0]
            for k in range(1, len(f)):
                conv[: n - k] += e[k:] @ f[k]
            best.append(np.maximum.reduceat(conv, spans, axis=0)[::2] + shift)
            if where:
                places.append(np.stack([b + conv[b:x].argmax(axis=0) for b, x in zip(begins, ends, strict=True)]))
        top = np.concatenate(best, axis=1)
        return (np.maximum(top, 0), top, places, e) if where else np.maximum(top, 0)

    def scores(self, texts: list[bytes], hashes: WordHashes) -> np.ndarray:
        out, group, size = [], [], 0

        def close() -> None:
            if group:
                out.append(self.pooled(*buckets(group, hashes)) @ self.out + self.bias)
                group.clear()

        for t in texts:
            if size + len(t) > 6 * STEP_WORDS:
                close()
                size = 0
            group.append(t)
            size += len(t)
        close()
        x = np.concatenate(out) if out else np.zeros(0)
        return 1.0 / (1.0 + np.exp(-np.clip(x.astype(np.float64), -35, 35)))


def log_odds(net: Network, rows: list[tuple[np.ndarray, np.ndarray, int]]) -> None:
    """Start the table with each bucket's log odds of the class over documents, drawn to 0 where rare."""
    count = np.zeros((2, BUCKETS))
    total = np.ones(2)
    for one, two, y in rows:
        count[y][np.unique(np.concatenate([one, two]))] += 1
        total[y] += 1
    odds = np.log((count[1] + 0.5) / (total[1] + 1)) - np.log((count[0] + 0.5) / (total[0] + 1))
    seen = count.sum(axis=0)
    r = np.random.default_rng(1)
    net.table[:] = r.normal(0, 0.05, net.table.shape) * (seen > 0)[:, None]
    net.table[:, 0] = 0.5 * odds * seen / (seen + 20)
    net.table[0] = 0


def train(rows: list[tuple[bytes, int]]) -> Network:
    """Stochastic gradients with per-parameter rates (Adagrad), in the given order of rows."""
    net, hashes = Network(), WordHashes()
    data = []
    for text, y in rows:
        one, two, _ = buckets([text], hashes)
        data.append((one, two, int(y > 0)))
    log_odds(net, data)
    sums = {k: np.full_like(v, 1e-2) for k, v in (("table", net.table), ("shift", net.shift), ("out", net.out))}
    sums |= {f"f{k}": np.full_like(f, 1e-2) for k, f in enumerate(net.filters)}
    bias_sum = 1e-2
    for epoch in range(EPOCHS):
        order = np.random.default_rng(epoch).permutation(len(data))
        for part in np.split(order, range(BATCH, len(order), BATCH)) if len(order) else []:
            lengths = [len(data[k][0]) for k in part]
            begins = np.cumsum(lengths) - lengths
            one, two = (np.concatenate([data[k][j] for k in part]) for j in (0, 1))
            y = np.array([data[k][2] for k in part], np.float32)
            top, raw, places, e = net.pooled(one, two, begins, where=True)
            g = (1 / (1 + np.exp(-np.clip(top @ net.out + net.bias, -35, 35))) - y) / len(part)
            grad_top = g[:, None] * net.out * (raw > 0)

            def step(name: str, value: np.ndarray, grad: np.ndarray) -> None:
                sums[name] += grad * grad
                value -= RATE * grad / np.sqrt(sums[name])

            step("out", net.out, (g @ top).astype(np.float32))
            bias_sum += float(g.sum()) ** 2
            net.bias -= np.float32(RATE * g.sum() / np.sqrt(bias_sum))
            step("shift", net.shift, grad_top.sum(axis=0).reshape(net.shift.shape).astype(np.float32))
            touched, changes = [], []
            for w, (f, at) in enumerate(zip(net.filters, places, strict=True)):
                gw = grad_top[:, w * FILTERS : (w + 1) * FILTERS]
                grad_f = np.zeros_like(f)
                for k in range(len(f)):
                    place = np.minimum(at + k, len(e) - 1)
                    grad_f[k] = np.einsum("df,dfe->ef", gw, e[place])
                    touched.append(place.ravel())
                    changes.append((gw[:, :, None] * f[k].T[None]).reshape(-1, DIMS))
                step(f"f{w}", f, grad_f)
            places_, change = np.concatenate(touched), np.concatenate(changes)
            for side in (one, two):
                rows_, inverse = np.unique(side[places_], return_inverse=True)
                grad = np.zeros((len(rows_), DIMS), np.float32)
                np.add.at(grad, inverse, change)
                sums["table"][rows_] += grad * grad
                net.table[rows_] -= RATE * grad / np.sqrt(sums["table"][rows_])
            net.table[0] = 0
    return net


def calibrate(scores: np.ndarray, y: np.ndarray, langs: list[str | None]) -> dict[str, float]:
    """For each language, the threshold of the fewest errors, drawn to ``THRESHOLD`` by ``PULL``."""
    out: dict[str, float] = {}
    for lang in sorted({x for x in langs if x is not None}):
        mine = np.array([x == lang for x in langs])
        s, t = scores[mine], y[mine]
        if min((t == 1).sum(), (t == 0).sum()) < LEAST:
            continue
        order = np.argsort(s, kind="stable")
        s, t = s[order], t[order]
        errors = np.append(0.0, np.cumsum(t == 1)) + np.append(np.cumsum((t == 0)[::-1])[::-1], 0)
        errors[1:-1][s[1:] == s[:-1]] = len(s) + 1  # no threshold parts equal scores
        low, high = np.append(0.0, s), np.append(s, 1.0)
        at = np.where((low < THRESHOLD) & (THRESHOLD <= high), THRESHOLD, np.clip((low + high) / 2, 1e-6, 1 - 1e-6))
        logit = lambda x: np.log(x / (1 - x))
        out[lang] = float(at[np.argmin(errors + PULL * np.abs(logit(at) - logit(THRESHOLD)))])
    return out


def _train_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [r for b in batches for r in zip(b.column(0).to_pylist(), utf8(b.column(1)), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
    rows.sort(key=lambda r: (str(r[0]), r[1]))
    net = train([(t, y) for k, (_, t, _, y) in enumerate(rows) if k % CALIBRATION])
    rest = rows[::CALIBRATION]
    thresholds = calibrate(net.scores([r[1] for r in rest], WordHashes()), np.array([r[3] for r in rest]), [r[2] for r in rest])
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((net, thresholds))], pa.binary())], names=["model"])


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", *, modulus: int = 4, remainder: int = 2, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", rows: int = SAMPLE_ROWS) -> tuple[Network, dict[str, float]]:
    """Network and thresholds by language, from at most ``rows`` labelled rows outside the held-out part.

    Null labels and ids are left out, a null text is an empty one, and of an id's
    several labels the largest counts.  Without labelled rows the network is
    untrained (every text scores alike) and no language has a threshold.
    """
    sample = labelled_sample(docs, labels, label_col, modulus=modulus, remainder=remainder, id_col=id_col, text_col=text_col, lang_col=lang_col, rows=rows)
    model = sample.repartition(1).mapInArrow(_train_task, "model binary").head()
    return pickle.loads(model[0]) if model else (Network(), {})


def score_documents(docs: DataFrame, net: Network, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``lang`` (null if there is no such column) and ``score`` (0 to 1) for every row, repeated rows too.

    A null text counts as empty, and an empty one gets the score of the bias alone;
    texts may be of any length; an empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches):
            scores = held.value.scores(utf8(batch.column(1)), hashes)
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(scores, pa.float64())], names=["id", *batch.schema.names[2:], "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), lang.alias("lang"))
    return rows.mapInArrow(run, f"id {kind}, lang string, score double").withColumnRenamed("id", id_col)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Toxicity of every document, learned from ``labels.toxic`` outside the held-out quarter.

    ``flagged`` compares with the language's own ``threshold``.  Null and empty
    texts are scored too, a row with a null id is not held out, repeated rows
    have a row each, and other columns than id, text and language take no part.
    """
    net, thresholds = fit(docs, labels, lang_col="lang" if "lang" in docs.columns else None)
    scored = score_documents(docs, net)
    threshold = F.lit(THRESHOLD)
    for lang, at in thresholds.items():
        threshold = F.when(F.col("lang") == lang, at).otherwise(threshold)
    return scored.select(
        "doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        threshold.alias("threshold"), (F.col("score") >= threshold).alias("flagged"),
    )


def remove_toxic(docs: DataFrame, labels: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without the rows that their language's threshold rejects, all columns kept as they are.

    Rows without a language, and all if there is no such column, have the default
    threshold.  Repeated rows are judged each; an empty table stays empty.
    """
    known = lang_col in docs.columns
    net, thresholds = fit(docs, labels, text_col=text_col, lang_col=lang_col if known else None)
    held = docs.sparkSession.sparkContext.broadcast((net, thresholds))
    at, lang_at = docs.columns.index(text_col), docs.columns.index(lang_col) if known else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        net, thresholds = held.value
        for batch in slices(batches, at):
            langs = [None] * batch.num_rows if lang_at is None else batch.column(lang_at).to_pylist()
            most = np.array([thresholds.get(x, THRESHOLD) for x in langs])
            yield batch.filter(pa.array(net.scores(utf8(batch.column(at)), hashes) < most, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
