"""Language identification: multinomial logistic regression on TF-IDF character n-grams, trained by FTRL-proximal."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tenantlens.llm.common import HELD_OUT, fold, stage, table

BUCKETS = 1 << 15
ORDERS = 3
SAMPLE = 6_000  # labelled documents the weights are fitted on
EACH = 40  # of them a language has at least, where it has as many
CALIBRATION_FOLD = 1  # of the folds that may be learned from, the one that sets the temperature
UNKNOWN = "und"
_ASCII = np.array([chr(c) if chr(c).isalpha() else " " for c in range(128)]).astype("U1").view("<u4")


def ngrams(text: str) -> np.ndarray:
    """Hash buckets of all character n-grams of a text, of 1 to ORDERS characters.

    The text is lower-cased; ASCII characters that are no letters count as
    space, runs of space as one.
    """
    code = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")
    code = np.where(code < 128, _ASCII[np.minimum(code, 127)], code)
    gap = code == 32
    code = code[~(gap & np.concatenate(([False], gap[:-1])))].astype(np.uint64)
    out, h = [], np.zeros(len(code), np.uint64)
    for n in range(min(ORDERS, len(code))):
        h = (h[:len(code) - n] + code[n:]) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out.append((mixed >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64))
    return np.concatenate(out)


def term_frequencies(text: str) -> tuple[np.ndarray, np.ndarray]:
    count = np.bincount(ngrams(text), minlength=BUCKETS)
    at = np.flatnonzero(count)
    return at, 1 + np.log(count[at])


@dataclass
class Ftrl:
    """FTRL-proximal with per-coordinate rates and an elastic net, one weight column per class."""

    classes: int
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1
    z: np.ndarray = field(init=False)
    n: np.ndarray = field(init=False)

    def __post_init__(self):
        self.z, self.n = np.zeros((BUCKETS + 1, self.classes)), np.zeros((BUCKETS + 1, self.classes))

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) > self.l1, w, 0.0)

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        p = softmax(x @ w)
        p[y] -= 1
        g = x[:, None] * p
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def softmax(v: np.ndarray) -> np.ndarray:
    e = np.exp(v - v.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # BUCKETS rows and one for the constant
    temperature: float = 1.0

    def vector(self, at: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = tf * self.idf[at]
        x = x / max(1e-12, np.sqrt(x @ x))
        return np.append(at, BUCKETS), np.append(x, 1.0)

    def logits(self, at: np.ndarray, tf: np.ndarray) -> np.ndarray:
        at, x = self.vector(at, tf)
        return x @ self.weights[at]


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Documents of ``docs`` and how many have each n-gram bucket; counted over whole texts of all rows."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, rows = np.zeros(BUCKETS, np.int64), 0
        for b in batches:
            for t in b["text"]:
                total[np.unique(term_frequencies(t)[0])] += 1
                rows += 1
        at = np.flatnonzero(total)
        yield pd.DataFrame({"at": np.append(at, -1), "n": np.append(total[at], rows)})

    sums = docs.select("text").mapInPandas(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()  # BUCKETS + 1 rows at most
    df = np.zeros(BUCKETS, np.int64)
    inner = sums[sums["at"] >= 0]
    df[inner["at"].to_numpy()] = inner["n"].to_numpy()
    return int(sums.loc[sums["at"] < 0, "n"].sum()), df


def train(docs: DataFrame, *, sample: int = SAMPLE, epochs: int = 3) -> Model | None:
    """Fit on rows with text and lang outside the held-out fold; None where there are none.

    Document frequencies come from all such rows. The weights are fitted on at
    most ``sample`` of them and EACH a language, except those of
    CALIBRATION_FOLD, which set the temperature. Each language gives its share,
    the first by hash of id and text; rows equal in both count once.
    """
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select(
        "doc_id", "text", F.col("lang").cast("string").alias("lang"), fold(F.col("doc_id")).alias("fold")).where(F.col("fold") != HELD_OUT)
    rows, df = document_frequencies(known)
    if not rows:
        return None

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [term_frequencies(t) for t in b["text"]]
            yield pd.DataFrame({"lang": b["lang"], "fold": b["fold"], "turn": b["turn"], "at": [a.astype("<u2").tobytes() for a, _ in made],
                                "tf": [v.astype("<f4").tobytes() for _, v in made]})

    per = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).withColumn("most", F.greatest(F.lit(EACH), F.floor(F.col("n") * (sample / rows))))
    # twice as many by hash, so that few rows are ranked
    per = stage(per.select("lang", "most", (F.least(F.lit(1.0), 2 * F.col("most") / F.col("n")) * (1 << 30)).cast("long").alias("_below")))
    near = known.withColumn("turn", F.xxhash64("doc_id", "text")).join(per, "lang").where(F.pmod("turn", F.lit(1 << 30)) < F.col("_below")).dropDuplicates(["lang", "turn"])
    chosen = near.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy("turn"))).where("_r <= most").select("text", "lang", "fold", "turn")
    got = chosen.mapInPandas(features, "lang string, fold int, turn long, at binary, tf binary").toPandas().sort_values(["turn", "at"], ignore_index=True)
    languages = sorted(got["lang"].unique())
    idf = np.log((1 + rows) / (1 + df)) + 1
    model = Model(languages, idf, np.zeros((BUCKETS + 1, len(languages))))
    cases = [(np.frombuffer(a, "<u2").astype(np.int64), np.frombuffer(v, "<f4").astype(float), languages.index(lang), f)
             for a, v, lang, f in zip(got["at"], got["tf"], got["lang"], got["fold"])]
    fit = [c for c in cases if c[3] != CALIBRATION_FOLD] or cases
    ftrl = Ftrl(len(languages))
    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(len(fit)):
            ftrl.learn(*model.vector(*fit[i][:2]), fit[i][2])
    model.weights = ftrl.weights(slice(None))
    check = [c for c in cases if c[3] == CALIBRATION_FOLD]
    if check:
        logits, y = np.array([model.logits(*c[:2]) for c in check]), np.array([c[2] for c in check])
        steps = np.exp(np.linspace(np.log(0.05), np.log(5), 60))
        loss = [-np.log(softmax(logits / t)[np.arange(len(y)), y] + 1e-12).mean() for t in steps]
        model.temperature = float(steps[int(np.argmin(loss))])
    return model


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """All columns of ``docs`` with lang_pred and score added or replaced; reads the text alone.

    A null text, one without a letter, or no model gives ``und`` and 0.
    """
    @F.pandas_udf("lang_pred string, score double")
    def guess(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                if model is None or not t or not any(map(str.isalpha, t)):
                    rows.append((UNKNOWN, 0.0))
                    continue
                p = softmax(model.logits(*term_frequencies(t)) / model.temperature)
                best = int(p.argmax())
                rows.append((model.languages[best], float(p[best])))
            yield pd.DataFrame(rows, columns=["lang_pred", "score"])

    out = docs.withColumn("_guess", guess(F.col("text")))
    return out.withColumns({"lang_pred": F.col("_guess.lang_pred"), "score": F.col("_guess.score")}).drop("_guess")


def op3_ftrl_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = predict(docs.select("doc_id", "text"), train(docs))
    return out.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "lang_pred", "score")


QUERIES = {"op3_ftrl_language": op3_ftrl_language}
