"""Language of texts by string kernels.

The kernel of two texts is their blended spectrum of n-gram presence: the number of n-grams of one to three letter classes
that both hold, over the root of the product of the numbers each holds. Landmarks, texts of a bounded sample, give the Nyström
features; a kernel ridge regression of one language against the rest is fitted on them. As presence kernels are linear in
presence, the weights of landmarks fold into one matrix of n-grams by languages, and texts are scored in batches by its
product with their presence rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

# Letter classes: 0 stands for a run of anything else, a-z have their own, all other letters share the rest by code point.
CLASSES = 49
FEATURES = CLASSES + CLASSES**2 + CLASSES**3
# Bounds of the sample: rows of one language, rows in all, and landmarks among them.
PER_LANGUAGE, SAMPLE, LANDMARKS, RIDGE = 400, 4000, 400, 1e-3
BATCH = 64
UNKNOWN = "und"

_TABLE: list[np.ndarray] = []


def classes_of(text: str) -> np.ndarray:
    """Classes of the lower-cased text's characters, runs of class 0 as one, with one at either end."""
    if not _TABLE:
        table = np.zeros(0x110000, np.uint8)
        for c in range(0x110000):
            if chr(c).isalpha():
                table[c] = 1 + c - 97 if 97 <= c <= 122 else 27 + c * 7919 % (CLASSES - 27)
        _TABLE.append(table)
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")
    found = _TABLE[0][codes].astype(np.int32)
    return found[np.concatenate([[True], (found[1:] != 0) | (found[:-1] != 0)])]


def presence(text: str, row: np.ndarray) -> None:
    """Mark the n-grams that the whole text holds in a row of FEATURES flags."""
    c = classes_of(text)
    row[c] = 1
    two = c[:-1] * CLASSES + c[1:]
    row[CLASSES + two] = 1
    row[CLASSES + CLASSES**2 + two[:-1] * CLASSES + c[2:]] = 1


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # n-grams by languages
    used: np.ndarray  # their n-grams
    bias: np.ndarray

    def scores(self, texts: list[str]) -> np.ndarray:
        return self.judged(texts)[0]

    def judged(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores by text and language, and the share of each text's n-grams that the landmarks hold."""
        flags = np.zeros((len(texts), FEATURES), np.uint8)
        for row, text in zip(flags, texts, strict=True):
            presence(text, row)
        size, held = np.count_nonzero(flags, axis=1), flags[:, self.used]
        return held.astype(np.float32) @ self.weights / np.sqrt(size)[:, None] + self.bias, np.count_nonzero(held, axis=1) / size


def fit(rows: list[np.ndarray], languages: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Model from n-gram sets (sorted numbers) and their languages; the first rows serve as landmarks."""
    names = sorted(set(languages))
    used = np.unique(np.concatenate(rows[:landmarks]))

    def kernel_side(some: list[np.ndarray]) -> np.ndarray:
        flags = np.zeros((len(some), FEATURES), np.float32)
        for flag, row in zip(flags, some, strict=True):
            flag[row] = 1 / np.sqrt(len(row))
        return flags[:, used]

    def batches(some: list[np.ndarray]):
        return (kernel_side(some[i : i + BATCH]) for i in range(0, len(some), BATCH))

    marks = np.concatenate(list(batches(rows[:landmarks])))
    values, vectors = np.linalg.eigh(np.concatenate([x @ marks.T for x in batches(rows[:landmarks])]).astype(np.float64))
    good = values > 1e-6 * values[-1]
    root = vectors[:, good] / np.sqrt(values[good])
    features = np.concatenate([x @ marks.T for x in batches(rows)]).astype(np.float64) @ root
    truth = np.where(np.array(languages)[:, None] == np.array(names), 1.0, -1.0)
    share = np.array([1 / languages.count(x) for x in languages])[:, None]  # each language weighs the same
    share *= len(rows) / share.sum()
    mean, bias = (features * share).mean(0), (truth * share).mean(0)
    centred = features - mean
    inner = np.linalg.solve(centred.T @ (centred * share) + ridge * len(rows) * np.eye(len(mean)), centred.T @ ((truth - bias) * share))
    return Model(names, (marks.T @ (root @ inner)).astype(np.float32), used, (bias - mean @ inner).astype(np.float32))


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Model of the labelled rows: of each language the PER_LANGUAGE rows whose ids hash lowest, SAMPLE rows in all.

    Rows without id, language or letters are left out. None if nothing is left. Only n-gram sets of the sample, at most
    FEATURES flags a row, reach the driver.
    """
    hashed = F.md5(F.col(id_col).cast("string"))
    order = Window.partitionBy(lang_col).orderBy(hashed, id_col)
    chosen = labelled.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull()).select(id_col, lang_col).distinct()
    chosen = chosen.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= PER_LANGUAGE).orderBy("_place", lang_col).limit(SAMPLE)
    texts = labelled.select(id_col, lang_col, F.col(text_col).alias("_text")).join(F.broadcast(chosen), [id_col, lang_col])

    def sets(batches):
        for batch in batches:
            kept, rows = [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                if has_letter(text):
                    flags = np.zeros(FEATURES, np.uint8)
                    presence(text, flags)
                    kept.append(i)
                    rows.append(np.packbits(flags).tobytes() if flags.sum() > FEATURES // 32 else np.flatnonzero(flags).astype("<u4").tobytes())
            take = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(rows, pa.binary())], names=["place", "lang", "grams"])

    found = texts.select("_place", lang_col, "_text").mapInArrow(sets, "place int, lang string, grams binary").collect()
    found.sort(key=lambda r: (r.place, r.lang, r.grams))
    if not found:
        return None
    whole = (FEATURES + 7) // 8
    rows = [np.flatnonzero(np.unpackbits(np.frombuffer(r.grams, np.uint8))[:FEATURES]) if len(r.grams) == whole else np.frombuffer(r.grams, "<u4") for r in found]
    return fit(rows, [r.lang for r in found])


def predict(docs: DataFrame, model: Model | None, columns: list[str], text_col: str = "text", known_col: str | None = None) -> DataFrame:
    """`columns` of each row with lang_pred and score (0 to 1) of the whole text; `und` and 0.0 for a null text or one without letters.

    The score is 0.5 where the best language's regression is undecided. `known_col` names a further column: the share of the
    text's n-grams that the model's landmarks hold, which tells texts in no learned language apart, as scores can't: those of
    L languages sum to a constant, so that the best is never below 1 / L. No shuffle; every row comes out, repeated ones too.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    made = ["lang_pred", "score", *([] if known_col is None else [known_col])]

    def run(batches):
        known = held.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            names, scores, shares = [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
            rows = [i for i, x in enumerate(texts) if known is not None and has_letter(x)]
            for at in range(0, len(rows), BATCH):
                some = rows[at : at + BATCH]
                found, share = known.judged([texts[i] for i in some])
                best = found.argmax(1)
                for i, b, s, n in zip(some, best.tolist(), found[np.arange(len(some)), best].tolist(), share.tolist(), strict=True):
                    names[i], scores[i], shares[i] = known.languages[b], min(1.0, max(0.0, (s + 1) / 2)), n
            more = [scores] if known_col is None else [scores, shares]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names, pa.string()), *(pa.array(x, pa.float64()) for x in more)], names=[*columns, *made])

    more = [StructField(c, StringType() if c == "lang_pred" else DoubleType()) for c in made]
    return docs.select(*columns, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, StructType([*(docs.schema[c] for c in columns), *more]))
