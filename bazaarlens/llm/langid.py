"""Operator 12: language identification by hierarchical discrimination.

A text is a histogram of hashed byte n-grams (GRAMS) of its lowered letters, its roots scaled to length one. A first
level of linear support vector machines, one for each family against the rest, gives the language family; within it,
one machine for each pair of languages votes. Families are those of FAMILY; a language that has none there is a
family of its own, so any value of the label column can be learned.

The machines are fitted on the driver by dual coordinate descent on the hinge loss, on at most TRAIN rows, of each
language about as many, chosen by a hash of id and text; vectors have DIM numbers each, so what the driver holds is
bounded (100 MB). All rows are predicted, from whole texts, in pieces of PIECE bytes.

Defined results: a row is held out if crc32 of its id in decimal, modulo FOLDS, is 0 (a null id counts as the empty
text, so it is held out); held-out rows, null labels and texts without a letter are not learned from. A null text or one
without a letter is ``und`` with score 0, and so is every text if nothing was learned. Rows that repeat an id are
predicted each for itself. Other columns are not read. An empty table gives no rows. ``train`` runs a job.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "und"
TRAIN, DIM, PIECE = 6000, 4096, 1 << 20
GRAMS, FOLDS = (1, 2, 3, 4), 5
#: How steeply a margin becomes a chance.
SLOPE = 4.0

# Language codes of ISO 639-1 by family.
FAMILY = {
    "Germanic": ["af", "da", "de", "en", "fo", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"],
    "Romance": ["ca", "es", "fr", "gl", "it", "oc", "pt", "ro"],
    "Slavic": ["be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "Celtic": ["br", "cy", "ga", "gd"],
    "Baltic": ["lt", "lv"],
    "Uralic": ["et", "fi", "hu"],
    "Turkic": ["az", "kk", "ky", "tk", "tr", "tt", "uz"],
    "Semitic": ["am", "ar", "he", "mt"],
    "Indo-Aryan": ["bn", "gu", "hi", "mr", "ne", "pa", "ur"],
    "Dravidian": ["kn", "ml", "ta", "te"],
    "Austronesian": ["id", "jv", "mg", "ms", "tl"],
}
_FAMILY = {code: family for family, codes in FAMILY.items() for code in codes}

_PRIMES = np.array([2654435761, 2246822519, 3266489917, 668265263], np.uint32)
# ASCII letters and all bytes of other characters stay, the rest is a space
_LETTERS = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))


def family(lang: str) -> str:
    return _FAMILY.get(lang.lower().replace("_", "-").split("-")[0], f"of {lang}")


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def vector(text: str) -> np.ndarray:
    """Roots of the shares of hashed n-grams, and a one for the bias."""
    data = b" " + text.lower().encode().translate(_LETTERS) + b" "
    counts = np.zeros(DIM, np.int64)
    for at in range(0, len(data), PIECE):
        for n in GRAMS:
            piece = np.frombuffer(data[at : at + PIECE + n - 1], np.uint8).astype(np.uint32)
            if len(piece) < n:
                continue
            mixed = np.full(len(piece) - n + 1, n, np.uint32)
            for k in range(n):
                mixed = (mixed ^ piece[k : len(piece) - n + 1 + k]) * _PRIMES[k]
                mixed ^= mixed >> np.uint32(15)
            counts += np.bincount(mixed % np.uint32(DIM), minlength=DIM)
    found = np.sqrt(counts / counts.sum())
    return np.append(found, 1.0).astype(np.float32)


def svm(x: np.ndarray, y: np.ndarray, cost: float = 4.0, epochs: int = 40, least: float = 1e-3, seed: int = 3) -> np.ndarray:
    """Weights of a linear support vector machine for labels -1 and 1, by dual coordinate descent. Rows of the rarer
    label cost more, so that both sides count alike."""
    n = len(y)
    each = cost * n / 2 / np.maximum(1, np.where(y > 0, (y > 0).sum(), (y < 0).sum()))
    norm = np.einsum("ij,ij->i", x, x)
    alpha, w = np.zeros(n), np.zeros(x.shape[1])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(n):
            slope = y[i] * float(x[i] @ w) - 1
            new = min(max(alpha[i] - slope / norm[i], 0.0), each[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < least * cost:
            break
    return w


@dataclass
class Model:
    families: list[str]
    by_family: np.ndarray  # a row of weights for each family, unless there is one only
    langs: dict[str, list[str]]
    pairs: dict[str, np.ndarray]  # for each family a row for each pair (i, j), i < j, of its languages

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.families or not has_letter(text):
            return UNKNOWN, 0.0
        x, name, sure = vector(text).astype(np.float64), self.families[0], 1.0
        if len(self.families) > 1:
            margins = self.by_family @ x
            first, second = np.argsort(-margins, kind="stable")[:2]
            name, sure = self.families[first], _chance(margins[first] - margins[second])
        langs = self.langs[name]
        if len(langs) > 1:
            margins, wins = self.pairs[name] @ x, np.zeros((len(langs), 2))
            at = np.zeros((len(langs), len(langs)))
            at[np.triu_indices(len(langs), 1)] = margins
            at -= at.T
            wins[:, 0], wins[:, 1] = (at > 0).sum(1), at.sum(1)
            best = max(range(len(langs)), key=lambda k: (*wins[k], -k))
            sure *= _chance(min(at[best, k] for k in range(len(langs)) if k != best))
            return langs[best], sure
        return langs[0], sure


def _chance(margin: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(SLOPE * margin, -40, 40))))


def fit(langs: list[str], x: np.ndarray) -> Model:
    own = np.array(langs)
    names = sorted(set(langs))
    families = sorted({family(n) for n in names})
    of = np.array([family(n) for n in langs])
    by_family = np.stack([svm(x, np.where(of == f, 1.0, -1.0)) for f in families]) if len(families) > 1 else np.zeros((0, DIM + 1))
    inside = {f: [n for n in names if family(n) == f] for f in families}
    pairs = {}
    for f, group in inside.items():
        made = []
        for i, a in enumerate(group):
            for b in group[i + 1 :]:
                rows = (own == a) | (own == b)
                made.append(svm(x[rows], np.where(own[rows] == a, 1.0, -1.0)))
        pairs[f] = np.stack(made) if made else np.zeros((0, DIM + 1))
    return Model(families, by_family, inside, pairs)


def held_out(ident: Column) -> Column:
    return F.crc32(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def train(docs: DataFrame, most: int = TRAIN, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Machines fitted on at most ``most`` rows that are not held out."""
    ident, text = F.col(id_col), F.col(text_col)
    rows = docs.where(~held_out(ident) & F.col(lang_col).isNotNull() & text.isNotNull()).select(ident.alias("id"), F.col(lang_col).alias("lang"), F.xxhash64(ident, text).alias("mark"))
    # of each language no more than ``most`` rows are wanted; tasks drop the others before each shuffle, and a frequent
    # language's rows meet in slices first
    ranked = rows.withColumn("slice", F.pmod("mark", F.lit(256)))
    for keys in (["lang", "slice"], ["lang"]):
        ranked = ranked.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("mark", "id"))).where(F.col("n") <= (most if keys == ["lang"] else -(-most // 64)))
    sample = ranked.orderBy("n", "lang").limit(most).select("id", "lang", "mark")
    # at most ``most`` rows of two numbers and a label; texts are read only for these
    chosen = docs.select(ident.alias("id"), F.col(lang_col).alias("lang"), text.alias("text")).withColumn("mark", F.xxhash64("id", "text"))
    chosen = chosen.join(F.broadcast(sample.distinct()), ["id", "lang", "mark"]).groupBy("id", "lang", "mark").agg(F.first("text").alias("text"))
    out = pa.schema([("lang", pa.string()), ("mark", pa.int64()), ("x", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(n, m, vector(t).tobytes()) for n, m, t in zip(*(c.to_pylist() for c in batch.columns)) if has_letter(t)]
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*made), out)], schema=out)

    found = chosen.select("lang", "mark", "text").mapInArrow(run, "lang string, mark long, x binary").toArrow().sort_by([("mark", "ascending"), ("lang", "ascending")])
    x = np.frombuffer(b"".join(found["x"].to_pylist()), np.float32).reshape(-1, DIM + 1)
    return fit(found["lang"].to_pylist(), x)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [shared.value.predict(t) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array([p[0] for p in found], pa.string()), pa.array([p[1] for p in found], pa.float64())], schema=out)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
