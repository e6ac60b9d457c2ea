"""Language identification (operator 10): sparse multinomial logistic regression on TF-IDF character
n-grams, trained with follow-the-regularised-leader (FTRL-proximal) under an elastic-net penalty,
followed by temperature calibration.

Document frequencies are counted over all learning documents. The weights are learned from a bounded
sample of them, drawn by a hash and balanced over languages, and the temperature from another; both
bounds are parameters. Prediction reads whole texts.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.llm.common import flat_text, numbered_columns, slices, unused

UNDETERMINED = "und"
ORDERS = (1, 2, 3)
GAP = 3  # spaces after each text, so that no n-gram joins two


@dataclass(frozen=True)
class Settings:
    bits: int = 16  # n-grams are hashed to 2 ** bits features
    fit_rows: int = 3000  # bound on the sample that the weights are learned from
    calibration_rows: int = 1000  # and on the one for the temperature
    row_features: int = 4096  # of a row of the sample, its n-grams that are most frequent
    most_languages: int = 200  # more labels than these are an error
    epochs: int = 3
    alpha: float = 0.5  # learning rate of FTRL
    beta: float = 1.0
    l1: float = 1e-4
    l2: float = 1e-4
    held_out_modulus: int = 4
    held_out_remainder: int = 2


@functools.lru_cache(maxsize=1)
def alphabet() -> np.ndarray:
    """Code point -> its lower-case letter, or a space where it is no letter."""
    out = np.full(0x110000, 32, np.uint32)
    for low, high in ((0, 0xD800), (0xE000, 0x32000)):  # no letters are assigned beyond
        for c in map(chr, range(low, high)):
            if c.isalpha():
                small = c.lower()
                out[ord(c)] = ord(small) if len(small) == 1 else ord(c)
    return out


def features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features (orders, characters), first character of each text, has a letter) of texts end to
    end. Runs of other characters are one space to the n-grams of a text, whatever its neighbours."""
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets] if len(data) else offsets
    n = len(offsets) - 1
    letters = alphabet()[points]
    lengths = np.diff(at)
    starts = np.concatenate([[0], np.cumsum(lengths + GAP)])
    spread = np.full(starts[-1] + GAP, 32, np.uint32)
    spread[np.arange(len(letters)) + np.repeat(starts[:-1] - at[:-1], lengths)] = letters
    lettered = np.add.reduceat((spread != 32).astype(np.int64), starts[:-1]) > 0 if n else np.zeros(0, bool)
    out, code = [], np.zeros(starts[-1], np.uint64)
    for k in range(max(ORDERS)):
        code = code * np.uint64(0x100000001B3) + spread[k : k + starts[-1]] + np.uint64(1)
        if k + 1 in ORDERS:
            mixed = (code + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
            out.append((mixed >> np.uint64(64 - bits)).astype(np.int32))
    grams = np.stack(out)
    for back in range(1, max(ORDERS)):  # those that would reach the next text: spaces, as at the end
        grams[:, starts[1:] - back] = grams[:, -1:]
    return grams, starts, lettered


def sparse_rows(found: np.ndarray, starts: np.ndarray, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(features, term frequencies as shares) of each text: of the `most` features that it has most often."""
    out = []
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        own, counts = np.unique(found[:, a:b], return_counts=True)
        shares = (counts / counts.sum()).astype(np.float32)
        if len(own) > most:
            top = np.sort(np.lexsort((own, -counts))[:most])
            own, shares = own[top], shares[top]
        out.append((own, shares))
    return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Ftrl:
    """FTRL-proximal: per-coordinate rates; L1 keeps weights at zero until evidence exceeds it."""

    def __init__(self, features_: int, classes: int, settings: Settings):
        self.z, self.n = np.zeros((features_, classes)), np.zeros((features_, classes))
        self.s = settings

    def weights(self, own: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[own], self.n[own]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.s.l1, 0)
        return -shrunk / ((self.s.beta + np.sqrt(n)) / self.s.alpha + self.s.l2)

    def learn(self, own: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(own)
        error = softmax(values @ w)
        error[label] -= 1
        gradient = np.outer(values, error)
        square = gradient * gradient
        n = self.n[own]
        self.z[own] += gradient - (np.sqrt(n + square) - np.sqrt(n)) / self.s.alpha * w
        self.n[own] = n + square


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search on its logarithm."""
    if not len(labels):
        return 1.0
    # The right class counts for (n + 1) / (n + 2), as after Platt: n rows that are all right do not
    # prove certainty, so the temperature doesn't fall to its bound.
    target = np.full(logits.shape, 1 / (len(labels) + 2) / max(1, logits.shape[1] - 1))
    target[np.arange(len(labels)), labels] = (len(labels) + 1) / (len(labels) + 2)
    loss = lambda t: -(target * np.log(softmax(logits / np.exp(t)) + 1e-12)).sum(axis=1).mean()
    low, high, ratio = np.log(0.02), np.log(50.0), (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    table: np.ndarray  # idf * weight of each feature and language
    bias: np.ndarray
    temperature: float
    bits: int

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and calibrated probability of each text; texts without a letter get und and 0."""
        n = len(offsets) - 1
        found, starts, lettered = features(data, offsets, self.bits)
        if not self.languages or not n:
            return [UNDETERMINED] * n, np.zeros(n)
        logits = np.zeros((n, len(self.languages)))
        for row in found:
            logits += np.add.reduceat(self.table[row], starts[:-1], axis=0, dtype=np.float64)
        logits = logits / (len(found) * np.diff(starts))[:, None] + self.bias
        p = softmax(logits / self.temperature)
        best = p.argmax(axis=1)
        names = [self.languages[k] if ok else UNDETERMINED for k, ok in zip(best.tolist(), lettered.tolist(), strict=True)]
        return names, np.where(lettered, p[np.arange(n), best], 0.0)


def held_out(id_column: str, settings: Settings):
    return F.coalesce(F.pmod(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(settings.held_out_modulus)) == settings.held_out_remainder, F.lit(False))


def learning_rows(df: DataFrame, settings: Settings, id_column: str, text_column: str, lang_column: str) -> DataFrame:
    """(id, text, lang) of rows with an id that is not held out, a text and a language."""
    rows = df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.col(lang_column).cast("string").alias("lang"), held_out(id_column, settings).alias("out"))
    return rows.where("id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL AND NOT out").drop("out")


def document_frequencies(rows: DataFrame, bits: int, slice_bytes: int) -> tuple[int, np.ndarray]:
    """(documents, documents that hold each feature), over all rows. Each task sends one count for
    each feature it met; the driver gets 2 ** bits sums, whatever the number of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held = np.zeros((1 << bits) + 1, np.int64), np.zeros(1 << bits, np.uint8)
        for whole in batches:
            for batch in slices(whole, "text", slice_bytes):
                found, starts, _ = features(*flat_text(batch.column(0)), bits)
                total[-1] += batch.num_rows
                for a, b in zip(starts[:-1], starts[1:], strict=True):
                    own = found[:, a:b].ravel()
                    if len(own) < 1 << bits >> 4:
                        total[np.unique(own)] += 1
                    else:
                        held[:] = 0
                        held[own] = 1
                        total[:-1] += held
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(total[met])], ["feature", "documents"])

    sums = rows.select("text").mapInArrow(run, "feature int, documents long").groupBy("feature").agg(F.sum("documents").alias("documents")).toArrow()
    out = np.zeros((1 << bits) + 1, np.int64)
    out[sums["feature"].to_numpy()] = sums["documents"].to_numpy()
    return int(out[-1]), out[:-1]


def samples(rows: DataFrame, settings: Settings, languages: dict[str, int], slice_bytes: int) -> list[tuple[str, int, np.ndarray, np.ndarray]]:
    """(language, draw, features, shares) of a bounded sample: as many rows of each language as the
    bounds allow, drawn by a hash of the row. languages: with their rows."""
    each = max(1, (settings.fit_rows + settings.calibration_rows) // len(languages))
    draw = F.xxhash64("id", "text")
    # Hashes below a language's threshold hold a little more than its rows of the sample, however many
    # rows it has; only those are ranked.
    share = {lang: min(1.0, (1.5 * each + 50) / n) for lang, n in languages.items()}
    threshold = F.create_map(*(F.lit(x) for lang, s in share.items() for x in (lang, min((1 << 63) - 1, int(s * (1 << 64)) - (1 << 63)))))
    low = rows.select("id", "lang", draw.alias("draw")).where(F.col("draw") <= threshold[F.col("lang")])
    ranked = low.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "id"))).where(F.col("rank") <= each)
    drawn = F.broadcast(ranked.select(F.col("id").alias("drawn"), "draw"))  # at most the two bounds together
    bits, most = settings.bits, settings.row_features
    chosen = rows.join(drawn, (rows["id"] == drawn["drawn"]) & (draw == drawn["draw"])).select("text", "lang", drawn["draw"])
    floats, ints = pa.list_(pa.float32()), pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", slice_bytes):
                found, starts, _ = features(*flat_text(batch.column(0)), bits)
                own, shares = zip(*sparse_rows(found, starts, most), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(own, ints), pa.array(shares, floats)], ["lang", "draw", "own", "shares"])

    got = chosen.mapInArrow(run, "lang string, draw long, own array<int>, shares array<float>").toArrow()
    rows_ = [(lang.as_py(), draw_.as_py(), own.values.to_numpy(), shares.values.to_numpy()) for lang, draw_, own, shares in zip(*(got[c] for c in got.column_names), strict=True)]
    return sorted(rows_, key=lambda r: (r[1], r[0]))


def fit(df: DataFrame, settings: Settings = Settings(), id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", slice_bytes: int = 1 << 18) -> Model:
    """Learns from the rows that are not held out. Without any, a model that knows no language."""
    rows = learning_rows(df, settings, id_column, text_column, lang_column)
    rows_of = {r[0]: r[1] for r in rows.groupBy("lang").count().limit(settings.most_languages + 1).collect()}
    if len(rows_of) > settings.most_languages:
        raise ValueError(f"there are more than {settings.most_languages} languages; weights of each are held on the driver")
    languages = sorted(rows_of)
    if not languages:
        return Model((), np.zeros((1 << settings.bits, 0), np.float32), np.zeros(0), 1.0, settings.bits)
    documents, frequency = document_frequencies(rows, settings.bits, slice_bytes)
    idf = np.log((1 + documents) / (1 + frequency)) + 1
    drawn = samples(rows, settings, rows_of, slice_bytes)
    labels = np.array([languages.index(r[0]) for r in drawn])
    share = settings.calibration_rows / (settings.fit_rows + settings.calibration_rows)
    fitted = np.floor((np.arange(len(drawn)) + 1) * share) == np.floor(np.arange(len(drawn)) * share)
    learner = Ftrl((1 << settings.bits) + 1, len(languages), settings)
    norm = [float(np.sqrt(np.square(s * idf[o]).sum())) for _, _, o, s in drawn]
    scale = 1 / (np.median(norm) or 1.0)  # one factor for all texts: typical rows have length one
    inputs = [(np.append(o, 1 << settings.bits), np.append(s * idf[o] * scale, 1.0)) for _, _, o, s in drawn]
    order = np.flatnonzero(fitted)
    for epoch in range(settings.epochs):
        for k in np.random.default_rng(epoch).permutation(order):
            learner.learn(*inputs[k], labels[k])
    weights = learner.weights(slice(None))
    rest = np.flatnonzero(~fitted)
    logits = np.array([values @ weights[own] for own, values in (inputs[k] for k in rest)]).reshape(len(rest), len(languages))
    return Model(tuple(languages), (weights[:-1] * (idf * scale)[:, None]).astype(np.float32), weights[-1], temperature(logits, labels[rest]), settings.bits)


def annotate(df: DataFrame, model: Model, text_column: str = "text", names: tuple[str, str] = ("lang_pred", "score"), slice_bytes: int = 1 << 18) -> DataFrame:
    """The rows of df with two more columns, language and score; columns of those names are replaced."""
    df = df.drop(*names)
    known = df.sparkSession.sparkContext.broadcast(model)  # 2 ** bits rows of one weight a language
    at, plain = df.columns.index(text_column), numbered_columns(df)
    columns = [*plain.columns, "language", "certainty"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, f"column_{at}", slice_bytes):
                languages, scores = known.value.predict(*flat_text(batch.column(at)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(languages, pa.string()), pa.array(scores, pa.float64())], columns)

    schema = T.StructType([*plain.schema.fields, T.StructField(columns[-2], T.StringType()), T.StructField(columns[-1], T.DoubleType())])
    return plain.mapInArrow(run, schema).toDF(*df.columns, *names)


def predict(df: DataFrame, model: Model, settings: Settings = Settings(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, held_out, lang_pred, score), one row for each row in.

    A null or empty text, and any without a letter, is `und` with score 0, as is every text to a model
    that knows no language. A null id is not held out. Rows that repeat get the same prediction; an
    empty table gives an empty result; only id and text are looked at.
    """
    return annotate(df.select(id_column, held_out(id_column, settings).alias("held_out"), text_column), model, text_column).drop(text_column)


def kept(df: DataFrame, model: Model, least_score: float = 0.3, text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """The rows of df whose language can be told: not `und`, and of at least that score. A missing
    language is filled in; columns stay as they are, whatever their names, and rows that repeat stay."""
    told, certainty = unused(df, "told", "certainty")
    found = annotate(df, model, text_column, (told, certainty)).where((F.col(told) != UNDETERMINED) & (F.col(certainty) >= least_score))
    return found.select(*(F.coalesce(f"`{lang_column}`", told).alias(c) if c == lang_column else F.col(f"`{c}`") for c in df.columns))


def identify(df: DataFrame, settings: Settings = Settings(), id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """fit() and predict() on one table."""
    return predict(df, fit(df, settings, id_column, text_column, lang_column), settings, id_column, text_column)
