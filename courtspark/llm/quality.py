"""Quality classifier with hierarchical empirical Bayes over sites.

A logistic regression on style features gives each document's evidence (the log of a Bayes factor). Hosts and paths
get posterior rates of good documents by grouped sums, a host shrunk towards the whole corpus and a path towards its
host; how strongly is estimated from the spread between sites (method of moments). A document's score joins its path's
posterior, as prior odds, with its own evidence. The posteriors that a document gets leave the document itself out, so
that nothing it says of itself, nor its own label, counts twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtspark.llm import words
from courtspark.llm.common import lowest, small, stored, text_key, text_or_empty, unused

#: Labelled rows the regression is fitted on, at most (those with the smallest hash of their id).
FIT_ROWS = 8_000
#: Evidence of one document is held within these log odds, so that neither side can become certain.
LIMIT = 12.0
FEATURES = ["log_words", "distinct", "repeated", "top_word", "symbols", "bars", "capitals", "digits", "word_bytes", "stops"]
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"!#$%&*+/<=>@\\^_`{|}~")] = True


def features(texts: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` per text; an empty or null text has zeros."""
    out = np.zeros((len(texts), len(FEATURES)))
    for a, b, raw, offs in words.chunks(texts):
        starts, ends, first = words.spans(raw, offs)
        counts = np.diff(first)
        text = np.repeat(np.arange(b - a), counts)
        h = words.hashes(words.LOWER[raw], starts, ends)
        n, size = np.maximum(counts, 1), np.maximum(np.diff(offs), 1)

        def per_text(flags, text=text, b=b, a=a):
            return np.bincount(text[flags], minlength=b - a)

        def per_byte(table, raw=raw, offs=offs):
            return np.diff(np.concatenate([[0], np.cumsum(table[raw])])[offs])

        order = np.lexsort((h, text))
        hs, ts = h[order], text[order]
        new = np.ones(len(hs), bool)
        new[1:] = (hs[1:] != hs[:-1]) | (ts[1:] != ts[:-1])
        at = np.flatnonzero(new)
        top = np.zeros(b - a, np.int64)
        np.maximum.at(top, ts[at], np.diff(np.append(at, len(hs))))
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
        last = raw[ends - 1]
        table = {c: np.arange(256) == ord(c) for c in "|"}
        upper, digit = np.zeros(256, bool), np.zeros(256, bool)
        upper[65:91], digit[48:58] = True, True
        out[a:b] = np.stack(
            [
                np.log1p(counts), np.bincount(ts[at], minlength=b - a) / n, per_text(again) / n, top / n, per_byte(_SYMBOL) / size,
                per_byte(table["|"]) / n, per_byte(upper) / size, per_byte(digit) / size, np.bincount(text, ends - starts, b - a) / n / 10,
                per_text((last == 46) | (last == 63)) / n,
            ],
            axis=1,
        )
    return out


def described(docs: DataFrame, host: Column, path: Column, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(doc_id, text_key, host, path, x): the features of each document, without its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features(b.column(4))
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], values], ["doc_id", "text_key", "host", "path", "x"])

    kind = docs.schema[id].dataType.simpleString()
    chosen = docs.select(
        F.col(id).alias("doc_id"), text_key(text).alias("text_key"), host.cast("string").alias("host"), path.cast("string").alias("path"), text_or_empty(text).alias("text"),
    )
    return chosen.mapInArrow(run, f"doc_id {kind}, text_key long, host string, path string, x array<double>")


def fit(x: np.ndarray, y: np.ndarray, l2: float = 0.1, rounds: int = 50) -> tuple[np.ndarray, float, float]:
    """(weights, intercept, log odds of the labels) by Newton steps on standardised features.

    Without rows of both labels nothing can be learnt: the weights are 0.
    """
    n, good = len(y), float(np.sum(y))
    if not 0 < good < n:
        return np.zeros(len(FEATURES)), 0.0, 0.0
    mean, scale = x.mean(0), np.where(x.std(0) > 1e-9, x.std(0), 1.0)
    z = np.column_stack([np.ones(n), (x - mean) / scale])
    w, ridge = np.zeros(z.shape[1]), np.full(z.shape[1], l2)
    ridge[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * w)
        w += step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    weights = w[1:] / scale
    return weights, float(w[0] - weights @ mean), float(np.log(good / (n - good)))


def _spread(groups: DataFrame, centre: Column) -> float:
    """Strength (in documents) of the prior for sites with ``n`` rows and sum ``s``, from their spread around ``centre``."""
    mean = F.col("s") / F.col("n")
    row = groups.agg(
        F.sum("n"), F.sum(F.col("n") ** 2), F.count("*"), F.sum("s"), F.sum(F.col("n") * (mean - centre) ** 2), F.sum("q")
    ).first()
    n, n2, g, s, between, squares = (float(v or 0) for v in row)
    if g < 2 or n <= g:
        return 1.0
    rate = min(max(s / n, 1e-6), 1 - 1e-6)
    within = max(squares / n - (s / n) ** 2 - between / n, 1e-9)
    variance = max((between - (g - 1) * within) / max(n - n2 / n, 1e-9), 1e-9)
    return float(min(max(rate * (1 - rate) / variance - 1, 1.0), 1e6))


def scores(
    docs: DataFrame, labels: DataFrame, host: Column, path: Column, text: str = "text", id: str = "doc_id", label: str = "quality", fit_rows: int = FIT_ROWS,
) -> DataFrame:
    """(doc_id, text_key, host, path, evidence, host_posterior, path_posterior, score, keep), a row per document.

    ``labels`` has ``id`` and ``label`` (1 good, 0 bad); of several labels of an id the mean counts, rounded, and null
    labels don't. A site's rate sums labels where there are some and the regression's probability elsewhere, over all
    documents but the one that is scored: the posteriors of two documents of a site differ by what they add to it. Null
    hosts or paths are sites of their own; a document alone at its site gets the level above. Without usable labels each
    score is 0.5; scores of at least 0.5 are kept. Whole texts are read, however long; a null text is an empty one.
    Repeated rows each count and get a row; an empty table gives no rows.
    """
    x = stored(described(docs, host, path, text, id), "quality")
    known = labels.where(F.col(label).isNotNull() & F.col(id).isNotNull()).groupBy(F.col(id).alias("doc_id")).agg(F.round(F.avg(label)).alias("y"))
    labelled = x.join(known, "doc_id", "left")
    usable = labelled.where("y is not null").select(F.struct("doc_id", "text_key").alias("row"), "x", "y")
    sample = lowest(usable, F.col("row"), fit_rows, usable.count()).select("x", "y").collect()
    w, b, base = fit(np.array([r.x for r in sample]).reshape(-1, len(FEATURES)), np.array([r.y for r in sample]))
    dot = F.lit(b - base)
    for k, weight in enumerate(w):
        dot = dot + F.col("x")[k] * F.lit(float(weight))
    evidence = F.greatest(F.least(dot, F.lit(LIMIT)), F.lit(-LIMIT))
    p = 1 / (1 + F.exp(-(F.col("evidence") + F.lit(base))))
    rated = stored(labelled.withColumn("evidence", evidence).withColumn("rate", F.coalesce("y", p)).drop("x", "y"), "quality-rated")

    sums = [F.count("*").alias("n"), F.sum("rate").alias("s"), F.sum(F.col("rate") ** 2).alias("q")]
    paths = stored(rated.groupBy("host", "path").agg(*sums), "quality-paths")
    hosts = paths.groupBy("host").agg(*(F.sum(c).alias(c) for c in "nsq"))
    total = hosts.agg(F.sum("n"), F.sum("s")).first()
    overall = (total[1] + 1) / (total[0] + 2) if total[0] else 0.5
    k_host = _spread(hosts, F.lit(overall))
    at_host = hosts.select("host", F.col("n").alias("host_n"), F.col("s").alias("host_s")).alias("h")
    paths = paths.alias("p").join(at_host, F.col("p.host").eqNullSafe(F.col("h.host"))).select("p.*", "host_n", "host_s")
    k_path = _spread(paths, (F.col("host_s") + k_host * overall) / (F.col("host_n") + k_host))
    sites = stored(paths.select("host", "path", "n", "s", "host_n", "host_s"), "quality-sites")

    same = F.col("d.host").eqNullSafe(F.col("s.host")) & F.col("d.path").eqNullSafe(F.col("s.path"))
    joined = rated.alias("d").join(small(sites).alias("s"), same).select("d.*", "n", "s", "host_n", "host_s")
    # each level without the document itself
    rest = (F.lit(total[1] or 0.0) - F.col("rate") + 1) / F.lit((total[0] or 0) + 1)
    at_host = (F.col("host_s") - F.col("rate") + k_host * rest) / (F.col("host_n") - 1 + k_host)
    joined = joined.withColumn("host_posterior", at_host)
    joined = joined.withColumn("path_posterior", (F.col("s") - F.col("rate") + k_path * F.col("host_posterior")) / (F.col("n") - 1 + k_path))
    prior = F.greatest(F.least("path_posterior", F.lit(1 - 1e-6)), F.lit(1e-6))
    if not np.any(w):
        score = F.lit(0.5)
    else:
        score = 1 / (1 + F.exp(-(F.log(prior / (1 - prior)) + F.col("evidence"))))
    joined = joined.withColumn("score", score).withColumn("keep", F.col("score") >= 0.5)
    return joined.select("doc_id", "text_key", "host", "path", "evidence", "host_posterior", "path_posterior", "score", "keep")


def kept(docs: DataFrame, labels: DataFrame, host: Column, path: Column, text: str = "text", id: str = "doc_id", label: str = "quality") -> DataFrame:
    """The documents without those that the classifier rejects; all columns stay, and so do repeated rows."""
    bad = scores(docs, labels, host, path, text, id, label).where("not keep")
    bad_id, bad_key, own_key = unused(docs, "bad_id", "bad_key", "own_key")
    bad = stored(bad.select(F.col("doc_id").alias(bad_id), F.col("text_key").alias(bad_key)).distinct(), "rejected")
    marked = docs.withColumn(own_key, text_key(text))
    return marked.join(small(bad), F.col(id).eqNullSafe(F.col(bad_id)) & (F.col(own_key) == F.col(bad_key)), "left_anti").drop(own_key)
