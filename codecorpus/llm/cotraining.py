"""Operator 6: quality classifier by co-training.

Two views of a document never see each other's inputs: the content view
(byte and word statistics of the whole text) and the metadata view (source,
language, declared length). Each view has its own logistic classifier. In
every round each view labels the unlabelled rows it is confident of and hands
them to the other view's training set. Both views are then calibrated on
labelled rows that no fit has seen, and a logistic combination of the
calibrated views scores every document in one narrow pass over whole texts.

Bounded by parameters: ``max_labelled`` labelled and ``max_pool`` unlabelled
rows (smallest seeded hash of the id) feed the fits; their feature vectors,
not their texts, reach the driver. Every document is scored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, columns, held_out
from .toxicity import logistic

SOURCE_SLOTS, LANG_SLOTS = 32, 16
_EXTRAS = 9


def content_features(text: str | None) -> np.ndarray:
    """Square roots of the byte shares of a whole text, then shares of
    words, repeated words, repeated lines, capitals, digits, symbols and
    table marks, mean word length and log length. Empty text: zeros."""
    out = np.zeros(256 + _EXTRAS, np.float32)
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    if not raw:
        return out
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(np.float64)
    out[:256] = np.sqrt(counts / len(raw))
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n = max(1, len(words))
    follow = sum(a == b for a, b in zip(words, words[1:]))
    letters = counts[65:91].sum() + counts[97:123].sum() + counts[128:].sum()
    out[256:] = (len(words) / len(raw), 1 - len(set(words)) / n, 1 - len(set(lines)) / max(1, len(lines)), follow / n,
                 counts[65:91].sum() / max(1.0, letters), counts[48:58].sum() / len(raw),
                 counts[list(b"#*$%&|<>!")].sum() / n, len(raw) / n / 20, np.log1p(len(raw)) / 10)
    return out


def metadata_features(source: str | None, lang: str | None, n_chars: float | None) -> np.ndarray:
    """Hashed one-hot source and language, declared length; null is a value
    of its own and a null length counts as zero."""
    out = np.zeros(SOURCE_SLOTS + LANG_SLOTS + 2, np.float32)
    out[zlib.crc32(repr(source).encode("utf-8", "surrogatepass")) % SOURCE_SLOTS] = 1
    out[SOURCE_SLOTS + zlib.crc32(repr(lang).encode("utf-8", "surrogatepass")) % LANG_SLOTS] = 1
    size = np.log1p(max(0.0, float(n_chars))) if n_chars is not None and n_chars == n_chars else 0.0
    out[-2:] = (size / 10, (size / 10) ** 2)
    return out


@dataclass
class View:
    """Standardised logistic classifier of one view."""

    mean: np.ndarray
    scale: np.ndarray
    coef: np.ndarray

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, l2: float) -> View:
        mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        return View(mean, scale, logistic(View._wide((x - mean) / scale), y, l2))

    @staticmethod
    def _wide(z: np.ndarray) -> np.ndarray:
        return np.hstack([np.ones((len(z), 1)), np.clip(z, -8, 8)])

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self._wide((x - self.mean) / self.scale) @ self.coef, -12, 12)


@dataclass
class Model:
    views: tuple[View, View] | None
    combine: np.ndarray

    def score(self, content: np.ndarray, metadata: np.ndarray) -> np.ndarray:
        """Probability of good quality for rows of both views."""
        if not len(content):
            return np.empty(0)
        z = [np.ones(len(content))]
        if self.views:
            z += [self.views[0].logit(content), self.views[1].logit(metadata)]
        return 1 / (1 + np.exp(-np.clip(np.column_stack(z) @ self.combine[:len(z)], -30, 30)))


def co_train(xs: tuple[np.ndarray, np.ndarray], y: np.ndarray, pool: tuple[np.ndarray, np.ndarray],
             check: tuple[np.ndarray, np.ndarray], check_y: np.ndarray, rounds: int, confident: float,
             per_round: int, l2: float = 3.0) -> Model:
    """Exchange of confident pseudo-labels between the two views, then
    calibration and combination on the rows kept aside."""
    if len(set(y)) < 2:
        p = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
        return Model(None, np.array([np.log(p / (1 - p))]))
    train = [[xs[v]] for v in (0, 1)]
    target = [[y], [y]]
    free = np.ones(len(pool[0]), bool)
    views: list[View] = []
    for turn in range(rounds + 1):
        views = [View.fit(np.vstack(train[v]), np.concatenate(target[v]), l2) for v in (0, 1)]
        if turn == rounds or not free.any():
            break
        for v in (0, 1):
            p = 1 / (1 + np.exp(-views[v].logit(pool[v])))
            for label, sure in ((1.0, p), (0.0, 1 - p)):
                picks = np.flatnonzero(free & (sure >= confident))
                picks = picks[np.argsort(-sure[picks], kind="stable")][:per_round]
                free[picks] = False
                train[1 - v].append(pool[1 - v][picks])
                target[1 - v].append(np.full(len(picks), label))
    pair = (views[0], views[1])
    if len(set(check_y)) < 2:
        return Model(pair, np.array([0.0, 1.0, 0.0]))
    z = np.column_stack([np.ones(len(check_y))] + [views[v].logit(check[v]) for v in (0, 1)])
    return Model(pair, logistic(z, check_y, 0.5))


def _featured(b: pd.DataFrame) -> tuple[list[np.ndarray], list[np.ndarray]]:
    content = [content_features(t) for t in b["_text"]]
    meta = [metadata_features(s if isinstance(s, str) else None, g if isinstance(g, str) else None,
                              None if pd.isna(n) else n)
            for s, g, n in zip(b["_source"], b["_lang"], b["_n"], strict=True)]
    return content, meta


def _vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        content, meta = _featured(b)
        yield pd.DataFrame({"id": b["_id"], "y": b["_y"], "c": [x.tobytes() for x in content],
                            "m": [x.tobytes() for x in meta]})


def learn(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          source_col: str = "source", lang_col: str = "lang", length_col: str = "n_chars",
          label_col: str = "quality", max_labelled: int = 6_000, max_pool: int = 6_000, rounds: int = 4,
          confident: float = 0.97, per_round: int = 400, seed: int = 0) -> Model:
    """Fit on at most ``max_labelled`` labelled and ``max_pool`` unlabelled
    rows. Labels of the held-out fold (see ``held_out``) are never read; a
    third of the labelled rows only calibrates. A document with contradicting
    labels counts as bad; without rows of both labels the score is the
    constant share of good rows (0.5 without any)."""
    docs = columns(documents, _id=id_col, _text=text_col, _source=source_col, _lang=lang_col, _n=length_col)
    marks = (columns(labels, _id=id_col, _y=label_col).where(F.col("_id").isNotNull() & F.col("_y").isNotNull())
             .groupBy("_id").agg(F.min("_y").cast("double").alias("_y")))
    use = bounded_sample(marks.where(~held_out("_id")), "_id", max_labelled, seed)
    unlabelled = docs.select("_id").where("_id is not null").join(marks.select("_id"), "_id", "left_anti").distinct()
    use = use.unionByName(bounded_sample(unlabelled, "_id", max_pool, seed + 1).withColumn("_y", F.lit(-1.0)))
    # one row for each sampled id, whatever the number of its rows: at most max_labelled + max_pool reach the driver
    one = F.min(F.struct("c", "m", "y")).alias("x")
    rows = (docs.join(F.broadcast(use), "_id").mapInPandas(_vectors, "id long, y double, c binary, m binary")
            .groupBy("id").agg(one).select("id", "x.y", "x.c", "x.m").toPandas().sort_values("id"))
    width = SOURCE_SLOTS + LANG_SLOTS + 2
    c = np.frombuffer(b"".join(rows["c"]), np.float32).reshape(-1, 256 + _EXTRAS).astype(np.float64)
    m = np.frombuffer(b"".join(rows["m"]), np.float32).reshape(-1, width).astype(np.float64)
    y = rows["y"].to_numpy(float)
    aside = np.array([zlib.crc32(f"calibrate {i}".encode()) % 3 == 0 for i in rows["id"]], bool)
    fit, check, pool = (y >= 0) & ~aside, (y >= 0) & aside, y < 0
    return co_train((c[fit], m[fit]), y[fit], (c[pool], m[pool]), (c[check], m[check]), y[check], rounds, confident,
                    per_round)


def quality(documents: DataFrame, model: Model, text_col: str = "text", source_col: str = "source",
            lang_col: str = "lang", length_col: str = "n_chars", name: str = "quality_score") -> DataFrame:
    """``documents`` with a ``name`` column, the probability of good quality
    of each whole text. Null and empty texts are scored like any other."""
    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for text, source, lang, n in parts:
            content, meta = _featured(pd.DataFrame({"_text": text, "_source": source, "_lang": lang, "_n": n}))
            yield pd.Series(model.score(np.array(content, np.float64), np.array(meta, np.float64)))
    return documents.withColumn(name, score(F.col(text_col), F.col(source_col).cast("string"),
                                            F.col(lang_col).cast("string"), F.col(length_col).cast("double")))


def quality_rows(documents: DataFrame, labels: DataFrame, threshold: float = 0.5, **learning) -> DataFrame:
    """One row per document: doc_id, held_out, score, kept (score reaches the
    threshold). Repeated rows are scored each; an empty table gives no rows."""
    model = learn(documents, labels, **learning)
    docs = columns(documents, doc_id="doc_id", text="text", source="source", lang="lang", n_chars="n_chars")
    return (quality(docs, model, name="score")
            .select("doc_id", held_out("doc_id").alias("held_out"), "score",
                    (F.col("score") >= threshold).alias("kept")))
