"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy.

A text is cut into windows of ``WINDOW`` bytes. One network reads each window forwards, one backwards; both states of a
byte give its label probabilities, so every position is labelled with the context on either side. A window's evidence is
the mean log probability of its positions, a document's the sum over its windows. Training is backpropagation through
time over whole windows. Gates and states are squashed by a rational tanh, which numpy computes several times as fast.

Cases: a null text and one without any letter are ``und`` with score 0; so is every text if nothing could be learnt.
Whole texts are read, however long, ``BATCH`` windows at a time. Repeated rows each get their own result, an empty table
gives no rows, columns of the caller don't clash as only the named ones are read. Equal evidence goes to the language
that sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtspark.llm import words
from courtspark.llm.common import stored, text_or_empty

#: Training windows of a language, and languages learnt (the most frequent ones), at most; scoring has no limit.
FIT_WINDOWS, FIT_LANGUAGES = 2_000, 200
#: Windows drawn from one training text, at most.
FIT_DRAWS = 4
WINDOW, HIDDEN, BATCH = 64, 12, 2_048
UNKNOWN = "und"


def squash(x: np.ndarray) -> np.ndarray:
    """Rational tanh: odd, smooth, 1 from 3 on."""
    x = np.clip(x, -3, 3)
    s = x * x
    top = s + np.float32(27)
    top *= x
    s *= np.float32(9)
    s += np.float32(27)
    top /= s
    return top


def slope(x: np.ndarray) -> np.ndarray:
    """Derivative of ``squash``."""
    s = np.minimum(x * x, 9)
    return ((9 - s) / (3 * (3 + s))) ** 2


@dataclass
class Reader:
    """A gated recurrent network in one direction; columns are update gate, reset gate, new state."""

    byte: np.ndarray
    back: np.ndarray
    bias: np.ndarray

    @classmethod
    def fresh(cls, rng: np.random.Generator, hidden: int) -> Reader:
        draw = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
        return cls(draw(0.5, 256, 3 * hidden), draw(1 / np.sqrt(hidden), hidden, 3 * hidden), np.zeros(3 * hidden, np.float32))

    def states(self, codes: np.ndarray, live: np.ndarray, trace: list | None = None) -> np.ndarray:
        """(time, window, hidden); ``codes`` is (time, window), and only the first ``live[t]`` windows reach step t."""
        steps, n = codes.shape
        hid = len(self.back)
        out = np.zeros((steps, n, hid), np.float32)
        h = np.zeros((n, hid), np.float32)
        for t in range(steps):
            m = live[t]
            if not m:
                break
            a, before = self.byte[codes[t, :m]], h[:m]
            b = before @ self.back
            b += self.bias
            pre = a[:, : 2 * hid] + b[:, : 2 * hid]
            gates = squash(pre)
            gates += 1
            gates *= np.float32(0.5)
            z, r = gates[:, :hid], gates[:, hid:]
            new = r * b[:, 2 * hid :]
            new += a[:, 2 * hid :]
            after = squash(new)
            if trace is not None:
                trace.append((pre, gates, b[:, 2 * hid :], new, after, before))
            after = after + z * (before - after)
            out[t, :m] = after
            h = after
        return out

    def gradients(self, codes: np.ndarray, live: np.ndarray, trace: list, given: np.ndarray) -> list[np.ndarray]:
        """Gradients of (byte, back, bias) from those of the states, last step first."""
        hid = len(self.back)
        back, bias = np.zeros_like(self.back), np.zeros_like(self.bias)
        rows, parts = [], []
        carry = np.zeros((codes.shape[1], hid), np.float32)
        for t in reversed(range(len(trace))):
            m = live[t]
            pre, gates, inner, new, state, before = trace[t]
            z, r = gates[:, :hid], gates[:, hid:]
            g = given[t, :m] + carry[:m]
            d_new = g * (1 - z) * slope(new)
            d_gates = np.concatenate([g * (before - state), d_new * inner], axis=1) * slope(pre) * np.float32(0.5)
            d_b = np.concatenate([d_gates, d_new * r], axis=1)
            back += before.T @ d_b
            bias += d_b.sum(0)
            carry[:m] = g * z + d_b @ self.back.T
            rows.append(codes[t, :m])
            parts.append(np.concatenate([d_gates, d_new], axis=1))
        code, part = np.concatenate(rows), np.concatenate(parts)
        order = np.argsort(code, kind="stable")
        found, first = np.unique(code[order], return_index=True)
        byte = np.zeros_like(self.byte)
        byte[found] = np.add.reduceat(part[order], first, axis=0)
        return [byte, back, bias]


def laid_out(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(forward codes, backward codes, live) of windows whose lengths don't increase; codes are (time, window)."""
    t = np.arange(int(lengths[0]) if len(lengths) else 0)[:, None]
    inside = t < lengths
    ahead = raw[np.where(inside, starts + t, starts)]
    behind = raw[np.where(inside, starts + lengths - 1 - t, starts)]
    return ahead, behind, inside.sum(1)


@dataclass
class Model:
    languages: list[str]
    ahead: Reader
    behind: Reader
    out: np.ndarray
    shift: np.ndarray

    @classmethod
    def fresh(cls, languages: list[str], seed: int = 11, hidden: int = HIDDEN) -> Model:
        rng = np.random.default_rng(seed)
        weights = rng.normal(0, 0.3, (2 * hidden, len(languages))).astype(np.float32)
        return cls(languages, Reader.fresh(rng, hidden), Reader.fresh(rng, hidden), weights, np.zeros(len(languages), np.float32))

    def params(self) -> list[np.ndarray]:
        return [*vars(self.ahead).values(), *vars(self.behind).values(), self.out, self.shift]

    def labels(self, ahead: np.ndarray, behind: np.ndarray, live: np.ndarray, lengths: np.ndarray, traces=(None, None)) -> tuple:
        """Log probabilities (time, window, language) of every position, and the states behind them."""
        hid = self.out.shape[0] // 2
        fore, aft = self.ahead.states(ahead, live, traces[0]), self.behind.states(behind, live, traces[1])
        logit = fore @ self.out[:hid] + self.shift
        logit += mirrored(aft @ self.out[hid:], lengths)
        logit -= logit.max(-1, keepdims=True)
        logit -= np.log(np.exp(logit).sum(-1, keepdims=True))
        return logit, fore, aft

    def evidence(self, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """(text, language): sums over a text's windows of the mean log probability of their positions."""
        sizes = np.diff(offs)
        count = -(-sizes // WINDOW)
        text = np.repeat(np.arange(len(sizes)), count)
        place = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        starts = offs[text] + WINDOW * place
        lengths = np.minimum(WINDOW, offs[text + 1] - starts)
        order = np.argsort(-lengths, kind="stable")
        total = np.zeros((len(sizes), len(self.languages)))
        batch = max(64, min(BATCH, 4 * BATCH // len(self.languages)))
        for a in range(0, len(order), batch):
            own = order[a : a + batch]
            log_p = self.labels(*laid_out(raw, starts[own], lengths[own]), lengths[own])[0]
            inside = (np.arange(len(log_p))[:, None] < lengths[own])[..., None]
            mean = np.where(inside, log_p, 0).sum(0) / lengths[own, None]
            np.add.at(total, text[own], mean)
        return total

    def predicted(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(language number, its probability) of each text."""
        best, score = np.zeros(len(texts), int), np.zeros(len(texts))
        for a, b, raw, offs in words.chunks(texts):
            e = self.evidence(raw, offs)
            best[a:b] = e.argmax(1)
            score[a:b] = 1 / np.exp(e - e.max(1, keepdims=True)).sum(1)
        return best, score


def mirrored(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(time, window, ...) with the steps of each window in opposite order."""
    t = np.arange(len(x))[:, None]
    return x[np.maximum(lengths - 1 - t, 0), np.arange(x.shape[1])]


def gradients(model: Model, pieces: list[bytes], label: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean loss per position and its gradients; windows come longest first."""
    lengths = np.array([len(p) for p in pieces])
    raw, starts = np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(lengths) - lengths
    ahead, behind, live = laid_out(raw, starts, lengths)
    traces: tuple[list, list] = ([], [])
    log_p, fore, aft = model.labels(ahead, behind, live, lengths, traces)
    inside = (np.arange(len(log_p))[:, None] < lengths)[..., None]
    goal = np.eye(len(model.languages), dtype=np.float32)[label]
    share = np.where(inside, 1 / lengths[:, None] / len(pieces), 0).astype(np.float32)  # each window weighs the same
    loss = float(-(log_p * goal * share).sum())
    d = (np.exp(log_p) - goal) * share
    hid = model.out.shape[0] // 2
    d_aft = mirrored(d, lengths) * inside
    d_out = np.concatenate([np.tensordot(fore, d, ((0, 1), (0, 1))), np.tensordot(aft, d_aft, ((0, 1), (0, 1)))])
    g_ahead = model.ahead.gradients(ahead, live, traces[0], d @ model.out[:hid].T)
    g_behind = model.behind.gradients(behind, live, traces[1], d_aft @ model.out[hid:].T)
    return loss, [*g_ahead, *g_behind, d_out, d.sum((0, 1))]


def train(pieces: list[bytes], label: np.ndarray, languages: list[str], steps: int = 300, batch: int = 128, rate: float = 0.01, seed: int = 11) -> Model:
    """A model fitted by Adam on batches that hold all languages alike; half of the windows are cut short, as short texts are."""
    model, rng = Model.fresh(languages, seed), np.random.default_rng(seed)
    params = model.params()
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    own = [np.flatnonzero(label == k) for k in range(len(languages))]
    for step in range(1, steps + 1):
        drawn = [own[k][rng.integers(len(own[k]))] for k in rng.permutation(np.arange(batch) % len(own))] if len(own) <= batch else rng.integers(len(pieces), size=batch)
        cut = np.where(rng.random(batch) < 0.5, WINDOW, rng.integers(8, WINDOW, batch))
        chosen = sorted(((pieces[i][:c], label[i]) for i, c in zip(drawn, cut, strict=True)), key=lambda x: -len(x[0]))
        _, grads = gradients(model, [p for p, _ in chosen], np.array([y for _, y in chosen]))
        size = np.sqrt(sum(float((g * g).sum()) for g in grads))
        pace = rate * (1 - 0.9 * step / steps) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        for p, m, v, g in zip(params, first, second, grads, strict=True):
            g = g * min(1.0, 1.0 / max(size, 1e-12))
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= (pace * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
    return model


def has_letter(text: Column | str) -> Column:
    return F.coalesce((F.col(text) if isinstance(text, str) else text).rlike(r"\p{L}"), F.lit(False))


def sample(docs: DataFrame, usable: Column | None, text: str, lang: str) -> list[tuple[str, bytes]]:
    """At most ``FIT_WINDOWS`` (language, window) rows of each of at most ``FIT_LANGUAGES`` languages.

    Texts are drawn by their hash, so copies of a text count once; a text gives up to ``FIT_DRAWS`` windows, drawn from all.
    """
    known = docs.where(F.col(lang).isNotNull() & has_letter(text))
    known = (known if usable is None else known.where(usable)).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("body"))
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(FIT_LANGUAGES)
    counts = F.broadcast(stored(counts, "languages"))  # at most FIT_LANGUAGES rows
    of = 1 << 30
    rank = F.pmod(F.xxhash64("body"), F.lit(of))
    drawn = known.join(counts, "lang").where(rank <= F.lit(4.0 * FIT_WINDOWS * of) / F.col("count"))
    count = F.ceil(F.octet_length("body") / WINDOW)
    draws = F.array_distinct(F.array(*[F.pmod(F.xxhash64("body", F.lit(k)), count) for k in range(FIT_DRAWS)]))
    drawn = drawn.select("lang", "body", F.xxhash64("body", F.lit(FIT_DRAWS)).alias("h"), F.posexplode(draws).alias("draw", "place"))
    piece = F.substring(F.col("body").cast("binary"), (F.col("place") * WINDOW + 1).cast("int"), F.lit(WINDOW))
    drawn = drawn.groupBy("lang", "draw", "h").agg(F.min(piece).alias("piece"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "h"))
    rows = drawn.withColumn("place", place).where(F.col("place") <= FIT_WINDOWS).collect()
    return [(r.lang, bytes(r.piece)) for r in sorted(rows, key=lambda r: (r.lang, r.draw, r.h))]


def fitted(docs: DataFrame, usable: Column | None = None, text: str = "text", lang: str = "lang") -> Model | None:
    """A model trained on a bounded sample of the documents that have a language; None if there are none."""
    rows = sample(docs, usable, text, lang)
    if not rows:
        return None
    names = sorted({name for name, _ in rows})
    number = {name: k for k, name in enumerate(names)}
    return train([piece for _, piece in rows], np.array([number[name] for name, _ in rows]), names)


def identified(docs: DataFrame, model: Model | None, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(doc_id, lang_pred, score): the language of each whole text and its probability."""
    ship = docs.sparkSession.sparkContext.broadcast(model)  # a model of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ship.value
        for b in batches:
            known = b.column(2).to_numpy(zero_copy_only=False) & (own is not None)
            name, score = np.full(len(known), UNKNOWN, object), np.zeros(len(known))
            at = np.flatnonzero(known)
            if len(at):
                best, p = own.predicted(b.column(1).take(pa.array(at)))
                name[at], score[at] = np.array(own.languages, object)[best], p
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(name, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    chosen = docs.select(F.col(id).alias("doc_id"), text_or_empty(text).alias("text"), has_letter(text).alias("letters"))
    return chosen.mapInArrow(run, f"doc_id {docs.schema[id].dataType.simpleString()}, lang_pred string, score double")
