"""Quality classifier by co-training: a view of the text and a view of the metadata teach each other.

Both views are linear models over the presence of features. They are fitted on a bounded sample of
labelled documents and a bounded pool of unlabelled ones; every document is scored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, functions as F
from pyspark.sql.types import StructType

from gatewell.functions import quoted
from gatewell.llm.textcode import ALNUM, NON_SPACE, mixed, run_edges, signed, slices, words_of

SIGNS = NON_SPACE & ~ALNUM  # runs of punctuation are features like words
BUCKETS = 12


@dataclass(frozen=True)
class Settings:
    """``labelled_rows`` and ``pool_rows`` bound what is gathered for fitting, at any input size."""

    labelled_rows: int = 12_000
    pool_rows: int = 4_000
    rounds: int = 3
    confident: float = 0.99
    given_per_round: int = 400
    evidence: float = 4.2      # z-score a feature needs to enter a view
    ridge: float = 1e-3
    held_out: float = 0.3      # of the labelled sample, for calibration
    accept: float = 0.4        # below it a document is rejected; on held-out labels few good ones are


SETTINGS = Settings()


def _tagged(kind: int, values: np.ndarray) -> np.ndarray:
    return mixed(values.astype(np.uint64) + mixed(np.array([kind], np.uint64))[0])


def _level(values: np.ndarray, top: float) -> np.ndarray:
    return np.clip(values / top * BUCKETS, 0, BUCKETS - 1).astype(np.int64)


def _levels(texts, words, signs) -> list[np.ndarray]:
    """One feature of each kind for every text: levels of shares and sizes."""
    n, data = len(texts), texts.data
    size = np.maximum(np.diff(texts.bounds), 1)
    n_words = words.counts()

    def share(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(flags)))
        return (sums[texts.bounds[1:]] - sums[texts.bounds[:-1]]) / size

    # Text number above, 40 bits of the hash below: one fast sort tells distinct words apart.
    keys = np.sort(np.concatenate([(w.text.astype(np.uint64) << np.uint64(40))
                                   | (w.hashes >> np.uint64(24)) for w in (words, signs)]))
    fresh = keys[run_edges(keys)[:-1]] if len(keys) else keys
    distinct = (np.bincount((fresh >> np.uint64(40)).astype(np.int64), minlength=n)
                / np.maximum(n_words + signs.counts(), 1))
    levels = (
        _level(share((data >= 0x41) & (data <= 0x5A)), 1.0), _level(share(SIGNS[data]), 0.5),
        _level(share(data == 0x0A), 0.1), _level(distinct, 1.0),
        _level(size / np.maximum(n_words, 1), 24.0), _level(np.log2(n_words + 1.0), 20.0))
    return [_tagged(10 + kind, level) for kind, level in enumerate(levels)]


def _terms(texts) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    words, signs = words_of(texts, ALNUM), words_of(texts, SIGNS)
    return (np.concatenate([words.text, signs.text]),
            np.concatenate([_tagged(1, words.hashes), _tagged(2, signs.hashes)]),
            _levels(texts, words, signs))


def text_features(texts) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs, once each, ordered by text: words, runs of signs, levels."""
    text, feature, levels = _terms(texts)
    order = np.lexsort((feature, text))
    text, feature = text[order], feature[order]
    fresh = np.ones(len(text), bool)
    fresh[1:] = (text[1:] != text[:-1]) | (feature[1:] != feature[:-1])
    text = np.concatenate([text[fresh], *[np.arange(len(texts))] * len(levels)])
    feature = np.concatenate([feature[fresh], *levels])
    order = np.argsort(text, kind="stable")
    return text[order], feature[order]


def text_score(texts, names: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The sum of weights of a text's features. Only terms that have a weight are told apart."""
    n = len(texts)
    if len(names) == 0:
        return np.zeros(n)
    text, feature, levels = _terms(texts)
    text = np.concatenate([text, *[np.arange(n)] * len(levels)])
    feature = signed(np.concatenate([feature, *levels]))
    at = np.minimum(np.searchsorted(names, feature), len(names) - 1)
    known = names[at] == feature
    pair = np.unique(text[known] * len(names) + at[known])
    return np.bincount(pair // len(names), weights[pair % len(names)], n)


def _metadata(docs: DataFrame, metadata: tuple[str, ...]) -> Column:
    """The metadata view: an array of hashed values; numbers count by magnitude."""
    kinds = dict(docs.dtypes)
    found = []
    for name in metadata:
        if name in kinds:
            value = F.col(quoted(name))
            if kinds[name] in ("bigint", "int", "smallint", "tinyint", "double", "float"):
                value = F.floor(2 * F.log2(F.abs(value) + 1))
            found.append(F.xxhash64(F.lit(name), value.cast("string")))
    return F.array(*found).cast("array<bigint>")


def _features(batches):
    for batch in batches:
        for part, texts in slices(batch, "text"):
            text, feature = text_features(texts)
            offsets = np.searchsorted(text, np.arange(len(texts) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column("label"), part.column("turn"), part.column("meta"),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(signed(feature)))],
                names=["label", "turn", "meta", "words"])


_FEATURES_SQL = "label int, turn bigint, meta array<bigint>, words array<bigint>"
_MODEL_SQL = "view int, feature bigint, weight double"


class View:
    """A linear model over hashed features, with a calibrated logit."""

    def __init__(self, rows: list[np.ndarray], settings: Settings):
        self.settings = settings
        self.sizes = np.array([len(r) for r in rows], np.int64)
        flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        self.names, self.codes = np.unique(flat, return_inverse=True)
        self.row = np.repeat(np.arange(len(rows)), self.sizes)
        self.weights, self.bias = np.zeros(len(self.names)), 0.0
        self.scale, self.shift = 1.0, 0.0

    def logits(self) -> np.ndarray:
        """Calibrated, for all rows."""
        raw = np.bincount(self.row, self.weights[self.codes], len(self.sizes)) + self.bias
        return self.scale * raw + self.shift

    def fit(self, rows: np.ndarray, target: np.ndarray, held: np.ndarray,
            held_target: np.ndarray) -> None:
        chosen = np.zeros(len(self.sizes), bool)
        chosen[rows] = True
        use = chosen[self.row]
        place = np.zeros(len(self.sizes), np.int64)
        place[rows] = np.arange(len(rows))
        row, code = place[self.row[use]], self.codes[use]
        n, good = len(rows), float(target.sum())
        seen = np.bincount(code, minlength=len(self.names)).astype(float)
        hits = np.bincount(code, target[row], len(self.names))
        rate = good / n
        z = (hits - seen * rate) / np.sqrt(np.maximum(
            seen * rate * (1 - rate) * (1 - seen / n), 1e-9) + 1e-9)
        keep = (np.abs(z) >= self.settings.evidence) & (seen >= 5)
        inside = keep[code]
        row, code = row[inside], code[inside]
        # Rare class and common class weigh the same.
        weight = np.where(target > 0, 0.5 / max(rate, 1e-9), 0.5 / max(1 - rate, 1e-9)) / n
        self.weights, self.bias = _logistic(row, code, len(self.names), n, target, weight,
                                            self.settings.ridge)
        self.scale, self.shift = 1.0, 0.0
        raw = self.logits()[held]
        scale, shift = _logistic(np.arange(len(held)), np.zeros(len(held), np.int64), 1, len(held),
                                 held_target, np.full(len(held), 1 / len(held)), 1e-4, raw)
        self.scale, self.shift = max(float(scale[0]), 0.0), shift


def _logistic(row, code, n_features, n_rows, target, weight, ridge, value=None, steps=500):
    """Weighted logistic regression by adaptive gradient steps over (row, feature) entries."""
    theta, bias = np.zeros(n_features), 0.0
    g_theta, g_bias = np.full(n_features, 1e-12), 1e-12
    for _ in range(steps):
        entry = theta[code] if value is None else theta[code] * value
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, entry, n_rows) + bias, -30, 30)))
        error = (p - target) * weight
        per_entry = error[row] if value is None else error[row] * value
        gradient = np.bincount(code, per_entry, n_features) + ridge * theta * (1 / max(n_rows, 1))
        g_theta += gradient ** 2
        theta -= 0.5 * gradient / np.sqrt(g_theta)
        step = error.sum()
        g_bias += step ** 2
        bias -= 0.5 * step / np.sqrt(g_bias)
    return theta, float(bias)


def cotrain(label: np.ndarray, turn: np.ndarray, meta: list[np.ndarray],
            words: list[np.ndarray],
            settings: Settings = SETTINGS) -> list[tuple[int, int, float]]:
    """Fit both views; rows (view, feature, weight) of the joint score, view 2 being its bias.

    ``label`` is 1, 0, or -1 for the unlabelled pool; ``turn`` is a random number of the row that
    decides whether it is held out for calibration.
    """
    order = np.argsort(turn, kind="stable")
    label = label[order]
    views = [View([np.asarray(words[i], np.int64) for i in order], settings),
             View([np.asarray(meta[i], np.int64) for i in order], settings)]
    labelled = np.flatnonzero(label >= 0)
    n_held = max(1, int(len(labelled) * settings.held_out))
    held, train = labelled[:n_held], labelled[n_held:]
    if min(len(set(label[held])), len(set(label[train]))) < 2:
        # One class only: nothing to tell apart, so every document gets the rate of good labels.
        rate = np.clip(label[labelled].mean() if len(labelled) else 1.0, 1e-6, 1 - 1e-6)
        return [(2, 0, float(np.log(rate / (1 - rate))))]
    pool = np.flatnonzero(label < 0)
    truth = label.astype(float)
    given = [(np.zeros(0, np.int64), np.zeros(0)), (np.zeros(0, np.int64), np.zeros(0))]
    sure = np.log(settings.confident / (1 - settings.confident))
    for turn_no in range(settings.rounds + 1):
        for view, (rows, marks) in zip(views, given):
            view.fit(np.concatenate([train, rows]), np.concatenate([truth[train], marks]),
                     held, truth[held])
        if turn_no == settings.rounds or len(pool) == 0:
            break
        taken = []
        for source, receiver in ((0, 1), (1, 0)):
            logits = views[source].logits()[pool]
            new = []
            for mark, strength in ((1.0, logits), (0.0, -logits)):
                best = np.argsort(-strength, kind="stable")[:settings.given_per_round // 2]
                best = best[strength[best] >= sure]
                new.append((pool[best], np.full(len(best), mark)))
            rows = np.concatenate([r for r, _ in new])
            marks = np.concatenate([m for _, m in new])
            given[receiver] = (np.concatenate([given[receiver][0], rows]),
                               np.concatenate([given[receiver][1], marks]))
            taken.append(rows)
        pool = np.setdiff1d(pool, np.concatenate(taken))
    # The calibrated views are combined on the held-out labels; a view that tells nothing gets a
    # weight near zero there.
    logits = np.stack([v.logits() for v in views], axis=1)[held]
    n = len(held)
    mix, bias = _logistic(np.repeat(np.arange(n), 2), np.tile([0, 1], n), 2, n, truth[held],
                          np.full(n, 1 / n), 1e-3, logits.ravel())
    model = []
    for number, (view, part) in enumerate(zip(views, np.maximum(mix, 0.0))):
        for feature in np.flatnonzero(view.weights):
            model.append((number, int(view.names[feature]),
                          float(part * view.scale * view.weights[feature])))
        bias += part * (view.scale * view.bias + view.shift)
    return model + [(2, 0, float(bias))]


def fit_views(docs: DataFrame, labels: DataFrame, settings: Settings, metadata: tuple[str, ...],
              id_column: str, text_column: str) -> list[Row]:
    """Gather the bounded samples with Spark, fit in one task, return the model's rows.

    A document is good if its labels say quality 1 and not toxic. Documents are drawn by a hash of
    their id, so the sample does not depend on how rows are stored.
    """
    marks = (labels.where(F.col("quality").isNotNull() & F.col(quoted(id_column)).isNotNull())
             .groupBy(F.col(quoted(id_column)).cast("bigint").alias("id"))
             .agg(F.min(((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0))
                        .cast("int")).alias("label")))
    base = docs.select(F.col(quoted(id_column)).cast("bigint").alias("id"),
                       F.coalesce(F.col(quoted(text_column)), F.lit("")).alias("text"),
                       _metadata(docs, metadata).alias("meta")).where("id IS NOT NULL")
    turn = F.xxhash64(F.lit("quality"), F.col("id"))
    labelled_ids, total = marks.count(), base.select("id").count()

    def below(rows: int, of: int):
        share = min(1.0, rows / max(of, 1))
        return F.pmod(turn, F.lit(1 << 20)) < int(share * (1 << 20))

    # The ids of the labelled sample are few enough to be broadcast; labelled_rows bounds them.
    # A drawn share may exceed its aim a little, so a last limit keeps the promise exactly.
    drawn = marks.where(below(settings.labelled_rows, labelled_ids)).limit(settings.labelled_rows)
    sample = base.join(F.broadcast(drawn), "id").select("label", turn.alias("turn"), "meta", "text")
    pool = (base.where(below(settings.pool_rows, total)).limit(settings.pool_rows)
            .select(F.lit(-1).alias("label"), turn.alias("turn"), "meta", "text"))
    rows = sample.unionByName(pool).mapInArrow(_features, _FEATURES_SQL)

    def fitted(batches):
        label, turn, views = [], [], {"meta": [], "words": []}
        for batch in batches:
            label.append(batch.column("label").to_numpy())
            turn.append(batch.column("turn").to_numpy())
            for name, lists in views.items():
                column = batch.column(name)
                at = np.asarray(column.offsets)
                lists += np.split(column.flatten().to_numpy(), at[1:-1] - at[0])
        model = cotrain(np.concatenate([np.zeros(0, int), *label]),
                        np.concatenate([np.zeros(0, np.int64), *turn]),
                        views["meta"], views["words"], settings)
        view, feature, weight = zip(*model)
        yield pa.RecordBatch.from_arrays(
            [pa.array(view, pa.int32()), pa.array(feature, pa.int64()),
             pa.array(weight, pa.float64())], names=["view", "feature", "weight"])

    return rows.repartition(1).mapInArrow(fitted, _MODEL_SQL).collect()


def quality_scores(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id",
                   text_column: str = "text",
                   metadata: tuple[str, ...] = ("lang", "source", "n_chars"),
                   settings: Settings = SETTINGS, keep: Sequence[str] | None = None
                   ) -> DataFrame:
    """Every row of ``docs`` (its columns ``keep``, or all) with quality_score (chance that it is good) and accepted.

    The text view sees words, runs of signs and coarse shares (capitals, signs, line breaks,
    distinct words, word length, length). The metadata view sees ``metadata``. In each round a view
    is fitted, calibrated on held-out labels, and gives its most confident pool documents of either
    class to the other view; at the end the calibrated views are combined on the held-out labels.

    Null and empty texts have no words and are scored by what is left. Missing or null metadata is
    a value of its own. Rows with a null id are scored too, but never used to fit. Repeated labels
    of an id count as their worst. Without labels of both classes all rows get the rate of good
    labels, or 1 if there are none. Existing columns named like the results are replaced. An empty
    table gives no rows.
    """
    model = fit_views(docs, labels, settings, metadata, id_column, text_column)
    parts = {v: sorted((r["feature"], r["weight"]) for r in model if r["view"] == v)
             for v in (0, 1, 2)}
    tables = docs.sparkSession.sparkContext.broadcast(
        {v: (np.array([f for f, _ in rows], np.int64), np.array([w for _, w in rows], float))
         for v, rows in parts.items()})

    names = [c for c in (docs.columns if keep is None else keep)
             if c not in ("quality_score", "accepted")]
    frame = docs.select(*[F.col(quoted(c)) for c in names],
                        *([] if text_column in names else [F.col(quoted(text_column))]),
                        _metadata(docs, metadata).alias("_metadata"))
    width, text_at, meta_at = len(names), frame.columns.index(text_column), len(frame.columns) - 1

    def scored(batches):
        bias = tables.value[2][1].sum()
        words, word_weights = tables.value[0]
        values, value_weights = tables.value[1]
        for batch in batches:
            outputs = []
            for part, texts in slices(batch, text_at):
                n = len(texts)
                total = text_score(texts, words, word_weights)
                meta = part.column(meta_at)
                if len(values):
                    found = meta.flatten().to_numpy()
                    at = np.minimum(np.searchsorted(values, found), len(values) - 1)
                    weight = np.where(values[at] == found, value_weights[at], 0.0)
                    owner = np.repeat(np.arange(n), np.diff(np.asarray(meta.offsets)))
                    total += np.bincount(owner, weight, n)
                outputs.append(1 / (1 + np.exp(-np.clip(total + bias, -500, 500))))
            score = np.concatenate(outputs) if outputs else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:width], pa.array(score), pa.array(score >= settings.accept)],
                names=[*names, "quality_score", "accepted"])

    schema = StructType(frame.schema.fields[:width])
    schema = schema.add("quality_score", "double").add("accepted", "boolean")
    return frame.mapInArrow(scored, schema)
