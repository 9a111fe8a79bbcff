"""Toxicity by a convolutional text classifier in numpy.

A word is the mean of hashed embeddings of itself and of its first 3 to 6 bytes. Filters over one, two and three
neighbouring words are max-pooled over the whole text and joined by a logistic layer. Only the place where a filter is
largest carries gradient, so training touches few embeddings; their first coordinate starts at the log odds of the
bucket in the training texts. Scores are calibrated on texts set aside; a threshold per language is found there too.

All labelled texts are learnt from, whole. Spark counts the buckets; in each pass every part of the texts is trained on
in a task of its own, from the same model, and what the parts have changed is averaged.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtspark.llm import words
from courtspark.llm.common import stored, text_key, text_or_empty

#: Training texts of a part, and their bytes: about what a task holds at once. Texts and bytes of a batch within it.
PART, PART_BYTES, BATCH, BATCH_BYTES = 4_000, 1 << 24, 64, 1 << 18
EPOCHS, RATE, SEED = 4, 0.1, 7
#: Bins of calibration scores per unit of the logit.
BINS = 256
#: Numbers of a model are averaged as multiples of 1 / UNIT.
UNIT = 1 << 32
#: Texts in which a bucket must occur for half of its odds to count.
RARE = 5
#: Bits that tell which ids have a label, and bits of a row of them: 8 MB however many labels.
SLOTS, SLOT_ROW = 1 << 26, 1 << 15
BUCKETS, DIM, WIDTHS, FILTERS, PREFIXES = 1 << 16, 8, (1, 2, 3), 8, (3, 4, 5, 6)
#: Score from which a text counts as toxic when its language has no threshold of its own.
THRESHOLD = 0.3
_LETTER = np.zeros(256, bool)
_LETTER[48:58] = _LETTER[97:123] = _LETTER[128:] = True
#: Bytes as they are read: ASCII letters small, everything else but digits and bytes of other characters a space.
_READ = np.where(_LETTER[words.LOWER], words.LOWER, 32).astype(np.uint8)


@dataclass
class Words:
    """Words of a few texts: the buckets of each different word, which of them each place holds, each text's places."""

    buckets: np.ndarray
    word: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, raw: np.ndarray, offs: np.ndarray) -> Words:
        read = _READ[raw]
        starts, ends, first = words.spans(read, offs)
        whole = words.hashes(read, starts, ends)
        _, one, word = np.unique(whole, return_index=True, return_inverse=True)
        order = np.argsort(one)  # different words in order of their first place
        number = np.empty(len(one), np.int64)
        number[order] = np.arange(len(one))
        one, word = one[order], number[word]
        starts, ends = starts[one], ends[one]
        parts = [whole[one]] + [words.hashes(read, starts, np.minimum(starts + n, ends)) + np.uint64(n) for n in PREFIXES]
        return cls((words.mix(np.stack(parts, axis=1)) % np.uint64(BUCKETS)).astype(np.int64), word, first)


@dataclass
class Model:
    embedding: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    shift: float = 0.0
    scale: float = 1.0
    thresholds: dict = field(default_factory=dict)

    @classmethod
    def fresh(cls, seed: int = 7) -> Model:
        rng = np.random.default_rng(seed)
        filters = [rng.normal(0, 0.5 / np.sqrt(w * DIM), (w, DIM, FILTERS)) for w in WIDTHS]
        for f in filters:
            f[0, 0] = np.abs(f[0, 0]) + 0.5  # filters begin by looking for words of high odds
        n = FILTERS * len(WIDTHS)
        return cls(rng.normal(0, 0.05, (BUCKETS + 1, DIM)), filters, np.zeros(n), np.full(n, 0.1))

    def dense(self) -> list[np.ndarray]:
        return [*self.filters, self.bias, self.out]

    def pooled(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Each filter's largest answer over each text, and at which word (no answer below 0: then 0 and -1)."""
        texts, n = len(w.first) - 1, len(w.word)
        value = np.zeros((texts, FILTERS * len(WIDTHS)))
        at = np.full(value.shape, -1)
        some = np.flatnonzero(np.diff(w.first))
        if not len(some):
            return value, at
        vector = self.embedding[w.buckets].mean(axis=1)
        text_end = np.repeat(w.first[1:], np.diff(w.first))
        for k, (width, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            cols = slice(k * FILTERS, (k + 1) * FILTERS)
            answer = np.tile(self.bias[cols], (n, 1))
            for j in range(width):
                part = np.vstack([vector @ f[j], np.zeros(FILTERS)])  # beyond the text's end stands nothing
                place = np.arange(n) + j
                word = np.where(place < text_end, w.word[np.minimum(place, n - 1)], len(vector))
                answer += part[word]
            best = np.maximum.reduceat(answer, w.first[some])
            value[some, cols] = np.maximum(best, 0)
            hit = answer == np.repeat(best, np.diff(w.first)[some], axis=0)
            number = np.where(hit, np.arange(n)[:, None], n)
            found = np.minimum.reduceat(number, w.first[some])
            at[some, cols] = np.where(best > 0, found, -1)
        return value, at

    def logits(self, w: Words) -> np.ndarray:
        return self.pooled(w)[0] @ self.out + self.shift

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Between 0 and 1, higher for texts that are likelier toxic; empty texts have the score of no answers at all."""
        out = np.empty(len(texts))
        for a, b, raw, offs in words.chunks(texts):
            out[a:b] = 1 / (1 + np.exp(-np.clip(self.logits(Words.of(raw, offs)) * self.scale, -30, 30)))
        return out


@dataclass
class Steps:
    """AdaGrad's sums of squares: of the filters of each width, bias and output, of the shift, of each embedding."""

    params: list[np.ndarray]
    shift: float
    rows: np.ndarray

    @classmethod
    def fresh(cls, model: Model) -> Steps:
        return cls([np.full(p.shape, 1e-6) for p in model.dense()], 1e-6, np.full(BUCKETS + 1, 1e-4))


def batches(texts: pa.Array) -> Iterator[tuple[int, int, Words]]:
    """(first, last, words) of runs of whole texts."""
    for a, _, raw, offs in words.chunks(texts, BATCH_BYTES):
        for i in range(0, len(offs) - 1, BATCH):
            part = offs[i : i + BATCH + 1]
            yield a + i, a + i + len(part) - 1, Words.of(raw[part[0] : part[-1]], part - part[0])


def bucket_counts(coded: list[tuple[Words, np.ndarray]]) -> np.ndarray:
    """Texts of either label (0, 1) that hold each bucket."""
    seen = np.zeros((2, BUCKETS), np.int64)
    for w, toxic in coded:
        text, kinds = np.repeat(np.arange(len(toxic)), np.diff(w.first)), max(1, len(w.buckets))
        held = np.unique(text * kinds + w.word)
        held = np.unique((held // kinds)[:, None] * BUCKETS + w.buckets[held % kinds])
        np.add.at(seen, (toxic[held // BUCKETS].astype(int), held % BUCKETS), 1)
    return seen


def begin(seen: np.ndarray, total: np.ndarray, seed: int = SEED) -> Model:
    """The model before the first pass; without texts of both labels one that gives every text the same score."""
    model = Model.fresh(seed)
    if not total.all():
        model.out[:] = 0
        model.shift = 3.0 if total[1] else -3.0
        return model
    odds = np.log((seen[1] + 0.5) / (total[1] + 1)) - np.log((seen[0] + 0.5) / (total[0] + 1))
    model.embedding[:BUCKETS, 0] = odds * seen.sum(0) / (seen.sum(0) + RARE) / 2  # a bucket seen in few texts says little
    model.shift = -2.0
    return model


def train_pass(model: Model, steps: Steps, coded: list[tuple[Words, np.ndarray]], total: np.ndarray, rng: np.random.Generator, rate: float = RATE) -> None:
    """One pass of AdaGrad over batches of texts; ``total`` texts of the labels 0 and 1 are learnt from in all."""
    weights = 0.5 / total * total.sum()
    params = model.dense()
    for n in rng.permutation(len(coded)):
        w, toxic = coded[n]
        value, at = model.pooled(w)
        p = 1 / (1 + np.exp(-np.clip(value @ model.out + model.shift, -30, 30)))
        g = weights[toxic.astype(int)] * (p - toxic)
        back = np.where(at >= 0, g[:, None] * model.out, 0.0)
        grads, e_rows, e_grads = [np.zeros(f.shape) for f in model.filters], [], []
        for k, (width, f) in enumerate(zip(WIDTHS, model.filters, strict=True)):
            cols = slice(k * FILTERS, (k + 1) * FILTERS)
            for j in range(width):
                text, one = np.nonzero((at[:, cols] >= 0) & (at[:, cols] + j < w.first[1:, None]))
                rows = w.buckets[w.word[at[text, k * FILTERS + one] + j]]
                own = back[text, k * FILTERS + one][:, None]
                np.add.at(grads[k][j].T, one, own * model.embedding[rows].mean(axis=1))
                e_rows.append(rows)
                e_grads.append(own * f[j].T[one] / rows.shape[1])
        grads += [back.sum(axis=0), g @ value]
        size, shift = len(toxic), g.sum()
        for q, s, d in zip(params, steps.params, grads, strict=True):
            d = d / size + 1e-5 * q
            s += d * d
            q -= rate * 0.3 * d / np.sqrt(s)
        steps.shift += (shift / size) ** 2
        model.shift -= rate * shift / size / np.sqrt(steps.shift)
        rows, g = np.concatenate(e_rows), np.concatenate(e_grads) / size
        if len(rows):
            g = np.repeat(g, rows.shape[1], axis=0)
            used, number = np.unique(rows, return_inverse=True)
            number, total_g = number.ravel(), np.empty((len(used), DIM))
            for d in range(DIM):
                total_g[:, d] = np.bincount(number, g[:, d], len(used))
            steps.rows[used] += (total_g**2).mean(axis=1)
            model.embedding[used] -= rate * total_g / np.sqrt(steps.rows[used])[:, None]


def train(texts: list[str], toxic: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model:
    """A model fitted on a list of texts; without texts of both labels it gives every text the same score."""
    toxic = np.asarray(toxic)
    order = np.random.default_rng(seed).permutation(len(texts))
    texts, toxic = pa.array([texts[i] for i in order], pa.large_string()), toxic[order]
    coded = [(w, toxic[a:b]) for a, b, w in batches(texts)]
    total = np.array([(toxic == 0).sum(), (toxic == 1).sum()])
    model = begin(bucket_counts(coded), total, seed)
    if total.all():
        steps = Steps.fresh(model)
        for epoch in range(epochs):
            train_pass(model, steps, coded, total, np.random.default_rng([seed, epoch]), rate)
    return model


def settle(model: Model, z: np.ndarray, toxic: np.ndarray, lang: list, count: np.ndarray, share: float) -> None:
    """Scale and shift of the scores, and a threshold per language, from logits of texts the model wasn't fitted on.

    A logit stands for ``count`` texts. ``share`` is the part of toxic texts among all labelled ones; the texts are
    weighted to it.
    """
    if not len(z) or toxic.min() == toxic.max() or not np.any(model.out):
        return
    toxic_share = (count * toxic).sum() / count.sum()
    weight = count * np.where(toxic == 1, share / toxic_share, (1 - share) / (1 - toxic_share))
    goal = np.where(toxic == 1, 0.99, 0.01)
    a, b = 1.0, 0.0
    for _ in range(100):  # Newton steps of a two-parameter logistic fit
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        x = np.stack([z, np.ones(len(z))], axis=1)
        step = np.linalg.solve((x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (weight * (p - goal)))
        a, b = a - np.clip(step[0], -0.5, 0.5), b - np.clip(step[1], -1, 1)
    if a <= 0:
        return
    model.scale, model.shift = float(a), model.shift + float(b / a)
    score = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
    lang = np.array(lang, object)
    for name in sorted({x for x in lang if x is not None}):
        own = lang == name
        if not 0 < toxic[own].sum() < own.sum():
            continue
        cuts = np.unique(np.concatenate([score[own], [THRESHOLD]]))
        order = np.argsort(score[own])
        said, heavy = score[own][order], weight[own][order]
        below = np.searchsorted(said, cuts)
        all_from = np.append(np.cumsum(heavy[::-1])[::-1], 0.0)
        toxic_from = np.append(np.cumsum((heavy * toxic[own][order])[::-1])[::-1], 0.0)
        best = (-1.0, THRESHOLD)
        for cut, hit, called in zip(cuts, toxic_from[below], all_from[below], strict=True):
            f1 = 2 * hit / (called + toxic_from[0])
            if f1 > best[0] + 1e-12 or f1 > best[0] - 1e-12 and abs(cut - THRESHOLD) < abs(best[1] - THRESHOLD):
                best = (float(f1), float(cut))
        model.thresholds[name] = best[1]


def calibrate(model: Model, texts: list[str], toxic: np.ndarray, lang: list, share: float) -> None:
    """:func:`settle` on a list of texts."""
    if len(texts):
        z = np.concatenate([model.logits(w) for _, _, w in batches(pa.array(texts, pa.large_string()))])
        settle(model, z, np.asarray(toxic), lang, np.ones(len(z)), share)


def _counted(examples: DataFrame) -> np.ndarray:
    """Texts of either label that hold each bucket, over all ``examples``; a task hands on a row per bucket at most."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, BUCKETS), np.int64)
        for b in parts:
            toxic = b.column(1).to_numpy()
            for first, last, w in batches(b.column(0)):
                seen += bucket_counts([(w, toxic[first:last])])
        used = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(seen[0, used]), pa.array(seen[1, used])], ["bucket", "clean", "toxic"])

    rows = examples.select("body", "known_label").mapInArrow(run, "bucket long, clean long, toxic long")
    out = np.zeros((2, BUCKETS), np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("clean"), F.sum("toxic")).collect():  # one row per bucket, however many texts
        out[:, r[0]] = r[1:]
    return out


def _mixed_pass(learnt: DataFrame, model: Model, steps: Steps, total: np.ndarray, epoch: int) -> None:
    """One pass over all parts of ``learnt``, each trained on by itself from the same model; what comes out is averaged.

    An embedding is averaged over the parts that changed it, everything else over all of them, in fixed-point numbers:
    the order in which parts come in doesn't matter.
    """
    ship = learnt.sparkSession.sparkContext.broadcast((model, steps))  # of fixed size

    def trained(coded: list[tuple[Words, np.ndarray]]) -> pa.RecordBatch:
        own, sums = copy.deepcopy(ship.value)
        train_pass(own, sums, coded, total, np.random.default_rng([SEED, epoch]))
        used = np.flatnonzero(sums.rows != ship.value[1].rows)
        rest = np.concatenate([p.ravel() for p in own.dense() + sums.params] + [[own.shift, sums.shift]])
        rest = np.append(rest, np.zeros(-len(rest) % (DIM + 1))).reshape(-1, DIM + 1)
        numbers = np.rint(np.vstack([np.column_stack([own.embedding[used], sums.rows[used]]), rest]) * UNIT).astype(np.int64)
        names = np.concatenate([used, -1 - np.arange(len(rest))])
        return pa.RecordBatch.from_arrays([pa.array(names), *(pa.array(c) for c in numbers.T)], ["row", *(f"v{d}" for d in range(DIM + 1))])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, coded = None, []
        for b in parts:  # rows of a part stand together
            name, toxic = b.column(2).to_numpy(), b.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(name)) + 1), len(name)]
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                if a < z and name[a] != part:
                    if coded:
                        yield trained(coded)
                    part, coded = name[a], []
                coded += [(w, toxic[a + first : a + last]) for first, last, w in batches(b.column(0).slice(a, z - a))]
        if coded:
            yield trained(coded)

    columns = [f"v{d}" for d in range(DIM + 1)]
    changed = learnt.select("body", "known_label", "part").mapInArrow(run, "row long, " + ", ".join(f"{c} long" for c in columns))
    # a row per row of the model, however many texts
    rows = changed.groupBy("row").agg(F.count("*"), *(F.sum(F.col(c).cast("decimal(28,0)")).cast("double") for c in columns)).toPandas().sort_values("row")
    ship.unpersist()
    row, mean = rows["row"].to_numpy(), rows.iloc[:, 2:].to_numpy(np.float64) / rows.iloc[:, 1].to_numpy()[:, None] / UNIT
    model.embedding[row[row >= 0]], steps.rows[row[row >= 0]] = mean[row >= 0, :DIM], mean[row >= 0, DIM]
    rest, start = mean[row < 0][::-1].ravel(), 0
    for p in model.dense() + steps.params:
        p[...] = rest[start : start + p.size].reshape(p.shape)
        start += p.size
    model.shift, steps.shift = float(rest[start]), float(rest[start + 1])


def _binned(examples: DataFrame, model: Model) -> list:
    """(bin, label, language, texts) of all ``examples``, a row per bin of the logit."""
    ship = examples.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            z = np.concatenate([ship.value.logits(w) for _, _, w in batches(b.column(0))] or [np.empty(0)])
            yield pa.RecordBatch.from_arrays([pa.array(np.floor(np.clip(z, -60, 60) * BINS).astype(np.int64)), b.column(1), b.column(2)], ["bin", "label", "tongue"])

    rows = examples.select("body", "known_label", "tongue").mapInArrow(run, "bin long, label int, tongue string")
    return sorted(rows.groupBy("bin", "label", "tongue").count().collect(), key=lambda r: (r[0], r[1], r[2] or ""))


def _likely(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of ``docs`` but for those whose ``known_id`` is surely not in ``known``, so that few texts without a label are shuffled."""
    if docs.schema["known_id"].dataType != known.schema["known_id"].dataType:
        return docs  # equal ids of two types have different hashes
    slot = F.pmod(F.xxhash64("known_id"), F.lit(SLOTS))
    row, bit = F.floor(slot / SLOT_ROW).alias("slot_row"), slot % SLOT_ROW
    bits = known.groupBy(row).agg(F.bitmap_construct_agg(bit).alias("slot_bits"))
    eight = F.conv(F.hex(F.substring("slot_bits", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = eight.bitwiseAND(F.pow(F.lit(2), bit % 8).cast("int")) != 0
    return docs.withColumn("slot_row", row).join(F.broadcast(bits), "slot_row").where(held).select(*docs.columns)


def fitted(
    docs: DataFrame, labels: DataFrame, usable=None, text: str = "text", id: str = "doc_id", lang: str = "lang", label: str = "toxic",
) -> Model:
    """A model trained and calibrated on all labelled documents.

    ``usable`` is a condition on ``labels`` for rows that may be learnt from. A fifth of the documents (by the hash of
    the id) is set aside for calibration. A null text counts as empty; rows that share id and text are one document.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(id).isNotNull())
    known = known.where(usable) if usable is not None else known
    known = known.groupBy(F.col(id).alias("known_id")).agg(F.round(F.avg(label)).cast("int").alias("known_label"))
    known = stored(known.where("known_label IN (0, 1)"), "toxicity-labels")
    tongue = (F.col(lang) if lang in docs.columns else F.lit(None)).cast("string").alias("tongue")
    chosen = docs.select(F.col(id).alias("known_id"), text_key(text).alias("text_key"), text_or_empty(text).alias("body"), tongue)
    # one plan for all sizes: labels grow with the documents
    chosen = _likely(chosen, known).join(known.hint("merge"), "known_id")
    aside = F.pmod(F.xxhash64("known_id"), F.lit(5)) == 0
    examples = stored(chosen.select("known_label", "tongue", "body", F.xxhash64("known_id", "text_key").alias("h"), aside.alias("aside")), "toxicity-texts")
    once = examples.select("aside", "known_label", "h", F.octet_length("body").alias("size")).distinct()
    sums = once.groupBy("aside", "known_label").agg(F.count("*"), F.sum("size")).collect()
    total = np.array([sum(r[2] for r in sums if not r[0] and r[1] == y) for y in (0, 1)])
    if not total.all():
        return begin(np.zeros((2, BUCKETS)), total)
    # a part is read in the same order by every pass, however often a task is tried
    parts = max(-(-int(total.sum()) // PART), -(-sum(r[3] for r in sums if not r[0]) // PART_BYTES))
    dealt = examples.withColumn("part", F.pmod("h", F.lit(parts)).cast("int")).repartitionById(parts, F.col("part"))
    dealt = dealt.dropDuplicates(["part", "h"]).sortWithinPartitions("part", "h")
    dealt = stored(dealt, "toxicity-parts")
    learnt = dealt.where("NOT aside")
    model = begin(_counted(learnt), total)
    steps = Steps.fresh(model)
    for epoch in range(EPOCHS):
        _mixed_pass(learnt, model, steps, total, epoch)
    rows = _binned(dealt.where("aside"), model)
    share = sum(r[2] for r in sums if r[1]) / sum(r[2] for r in sums)
    settle(model, np.array([(r[0] + 0.5) / BINS for r in rows]), np.array([r[1] for r in rows]), [r[2] for r in rows], np.array([r[3] for r in rows]), share)
    return model


def scored(docs: DataFrame, model: Model, text: str = "text", id: str = "doc_id", lang: str = "lang") -> DataFrame:
    """(doc_id, score, threshold): whole texts scored; the threshold is the language's. A null text counts as empty."""
    ship = docs.sparkSession.sparkContext.broadcast(model)  # a model of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ship.value
        for b in batches:
            cut = pa.array([own.thresholds.get(x, THRESHOLD) for x in b.column(2).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own.scores(b.column(1))), cut], ["doc_id", "score", "threshold"])

    chosen = docs.select(F.col(id).alias("doc_id"), text_or_empty(text).alias("text"), (F.col(lang) if lang in docs.columns else F.lit(None)).cast("string").alias("lang"))
    return chosen.mapInArrow(run, f"doc_id {docs.schema[id].dataType.simpleString()}, score double, threshold double")
