"""Language identification by string kernels with Nyström landmarks and kernel ridge regression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curveloom.llm.common import map_batches

UNKNOWN = "und"
#: Lengths of the n-grams of the blended spectrum, and hashed places for each length.
LENGTHS, PLACES = (1, 2, 3), 1 << 13
#: Bounds of the fit, shared evenly by the languages (one row each at least): labelled rows the
#: regression is fitted on, and rows that are landmarks.
TRAIN_ROWS, LANDMARKS = 2048, 192
RIDGE = 1e-2
#: Texts in a matrix product, and code points looked at together.
ROWS, SPAN = 256, 1 << 20

_folds: list[np.ndarray] = []


def _fold() -> np.ndarray:
    """Code point to lower-case letter, or 0 if it is none; made once a process."""
    if not _folds:
        table = np.zeros(0x110000, np.uint32)
        for point in range(0x110000):
            letter = chr(point)
            if letter.isalpha():
                lower = letter.lower()
                table[point] = ord(lower) if len(lower) == 1 else point
        _folds.append(table)
    return _folds[0]


def presence(text: str | None) -> np.ndarray | None:
    """Which n-grams of letters (all else is one gap) a whole text has; None if it has no letter."""
    if not text:
        return None
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    found, any_letter = np.zeros(len(LENGTHS) * PLACES, bool), False
    carried = np.zeros(1, np.uint64)
    for at in range(0, len(codes) + 1, SPAN):
        letters = _fold()[codes[at:at + SPAN]]
        any_letter = any_letter or bool(letters.any())
        last = at + SPAN > len(codes)
        line = np.concatenate([carried, letters, np.zeros(int(last), np.uint64)]).astype(np.uint64)
        line = line[np.append(True, (line[1:] != 0) | (line[:-1] != 0))]
        rolled = np.zeros(len(line), np.uint64)
        for n, length in enumerate(LENGTHS):
            if len(line) < length:
                break
            rolled = rolled[:len(line) - length + 1] * np.uint64(0x9E3779B97F4A7C15) + line[length - 1:]
            mixed = (rolled ^ (rolled >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            found[n * PLACES + (mixed >> np.uint64(64 - 13)).astype(np.int64)] = True
        carried = line[-(max(LENGTHS) - 1):]
    return found if any_letter else None


@dataclass
class LanguageModel:
    """Scores are presence vectors, scaled to length one, times ``weights`` (places x languages).

    ``weights`` is the product of the landmarks' vectors and the dual coefficients: the kernel with
    every landmark followed by the regression on it, multiplied out once.
    """

    languages: list[str]
    weights: np.ndarray

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return (rows.astype(np.float32) @ self.weights) / np.sqrt(rows.sum(axis=1, dtype=np.float32))[:, None]


def is_held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 on division by 4; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def _bits(docs: DataFrame) -> DataFrame:
    """(lang, draw, bits) of the rows that have a letter."""
    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        found = [presence(t) for t in batch["text"].to_pylist()]
        return {"lang": batch["lang"], "draw": batch["draw"], "bits": pa.array(
            [None if f is None else np.packbits(f).tobytes() for f in found], pa.binary())}

    return map_batches(docs, ["lang", "draw", "text"], run, "lang string, draw long, bits binary").where(
        F.col("bits").isNotNull())


def _units(bits: list[bytes]) -> np.ndarray:
    """Presence vectors of length one."""
    rows = np.unpackbits(np.frombuffer(b"".join(bits), np.uint8).reshape(len(bits), -1), axis=1).astype(np.float32)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS, landmarks: int = LANDMARKS,
        ridge: float = RIDGE) -> LanguageModel | None:
    """Fit on a bounded sample, in hash order, of the labelled rows of ``docs`` (doc_id, text, lang).

    Presence kernel: common n-grams over the root of the product of both numbers. Landmarks are the
    first rows of each language in hash order; the Nyström features are K(x, landmarks) times the
    inverse root of K(landmarks, landmarks), and one ridge regression a language is fitted on them.
    Only the sample's bit vectors reach the driver. None if no row has a label and a letter.
    """
    labelled = docs.where(F.col("lang").isNotNull()).select(
        "lang", "text", F.xxhash64(F.lit(11), "doc_id").alias("draw"))
    counts = labelled.groupBy("lang").count().collect()
    if not counts:
        return None
    each = max(1, train_rows // len(counts))
    # Four times the rows wanted, so that those without letters hardly ever leave too few.
    shares = docs.sparkSession.createDataFrame(
        [(c["lang"], min(1.0, 4 * each / c["count"])) for c in counts], "name string, share double")
    drawn = labelled.join(F.broadcast(shares), F.col("lang") == F.col("name")).where(
        F.pmod("draw", F.lit(1 << 40)) < F.col("share") * F.lit(float(1 << 40)))
    in_order = Window.partitionBy("lang").orderBy("draw", "bits")
    rows = _bits(drawn).withColumn("n", F.row_number().over(in_order)).where(F.col("n") <= each).orderBy(
        "lang", "n").collect()
    if not rows:
        return None
    languages = sorted({r["lang"] for r in rows})
    bits = [bytes(r["bits"]) for r in rows]
    marks = _units([b for b, r in zip(bits, rows) if r["n"] <= max(1, landmarks // len(counts))])
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    sound = values > 1e-6 * values.max()
    root = vectors[:, sound] / np.sqrt(values[sound])
    features = np.concatenate([_units(bits[at:at + ROWS]) @ marks.T for at in range(0, len(bits), ROWS)]).astype(np.float64) @ root
    wanted = np.array([[float(r["lang"] == name) for name in languages] for r in rows])
    gram = features.T @ features + ridge * np.eye(features.shape[1])
    coefficients = root @ np.linalg.solve(gram, features.T @ wanted)
    return LanguageModel(languages, (marks.T.astype(np.float64) @ coefficients).astype(np.float32))


def predict(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """(doc_id, lang_pred, score) from whole texts alone.

    The language with the highest output wins, ties go to the first by name; the score is that output
    cut to 0..1. Texts that are null or have no letter are ``und`` with score 0, and so are all texts
    if there is no model.
    """
    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        texts = batch["text"]
        names = np.full(len(texts), UNKNOWN, object)
        scores = np.zeros(len(texts))
        for at in range(0, len(texts) if model else 0, ROWS):
            found = [presence(t) for t in texts.slice(at, ROWS).to_pylist()]
            known = [i for i, f in enumerate(found) if f is not None]
            if known:
                out = model.scores(np.stack([found[i] for i in known]))
                best = out.argmax(axis=1)
                names[[at + i for i in known]] = [model.languages[b] for b in best]
                scores[[at + i for i in known]] = np.clip(out[np.arange(len(best)), best], 0, 1)
        return {"doc_id": batch["doc_id"], "lang_pred": pa.array(names, pa.string()), "score": pa.array(scores)}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs, ["doc_id", "text"], run, f"doc_id {kind}, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score); learned from the labelled rows that are not held out.

    Repeated rows are judged alike; an empty table gives no rows.
    """
    model = fit(docs.where(~is_held_out(F.col("doc_id"))))
    return predict(docs, model).select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def identified_documents(docs: DataFrame, least_score: float) -> DataFrame:
    """The rows of ``docs`` whose text has a language with at least ``least_score``; all columns stay."""
    model = fit(docs.where(~is_held_out(F.col("doc_id"))))
    columns = docs.schema
    narrow = [f.name for f in columns]

    def keep(batches):
        for batch in batches:
            texts = batch.column(narrow.index("text"))
            good = np.zeros(len(texts), bool)
            for at in range(0, len(texts) if model else 0, ROWS):
                found = [presence(t) for t in texts.slice(at, ROWS).to_pylist()]
                known = [i for i, f in enumerate(found) if f is not None]
                if known:
                    out = model.scores(np.stack([found[i] for i in known]))
                    good[[at + i for i in known]] = out.max(axis=1) >= least_score
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(keep, columns)
