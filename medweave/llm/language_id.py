"""Language identification in two steps: the language family, then one-versus-one within it.

Features are hashed counts of one to three neighbouring letters (everything else reads as a gap) of the whole text,
as square roots of shares. Linear support vector machines with squared hinge loss are fitted on a bounded sample:
one-versus-rest for families, and one for each pair of languages of a family, whose votes decide.

The score is 0.5 or more where three things hold: the least margin of the language told (over other families, and over
each language of its own) is clear, the text's letter groups are about as probable in that language as those of its
documents, and letters are not rare in the text. The bounds are those of `bounds`, learned from what the sample's own
documents get from a model without them. Gibberish, languages that were not learned, texts half in another language and
tables of numbers fall below.

A text that is NULL or has no letter is ``und`` with score 0. Rows without a doc_id are not learned from and not held
out. Without anything to learn from, every text is ``und``; with one language, every text with a letter is told as it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import combinations
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, functions as F

from medweave.llm.common import query, table, unused

if TYPE_CHECKING:
    import numpy as np

# Families of related languages, by ISO 639-1 code. Any other language is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "is", "lb", "nl", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "pt", "ro"),
    "slavic": ("be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
}
UNKNOWN = "und"
WIDTH = 4096  # hashed features
PER_LANGUAGE = 300  # documents of a language that are learned from, at most about
MOST_LANGUAGES = 200  # of the labelled documents; more is an error
COST = 10.0
SMOOTH = 0.1  # weight of all letter groups alike next to those of a language's documents
LOW = 0.01  # share of the sample's right predictions that is taken as its low end
REACH = 4.0  # how many times as far below the median as the low end a text may be in probability
CLEAR = 0.1  # of the median margin
FEW = 0.5  # of the low end's share of letters


@cache
def letters() -> np.ndarray:
    import numpy as np

    return np.array([chr(c).isalpha() for c in range(0x110000)])


@cache
def spaces() -> np.ndarray:
    import numpy as np

    return np.array([chr(c).isspace() for c in range(0x110000)])


def described(text: str | None) -> tuple[np.ndarray, float] | None:
    """Unit vector of the text's letter groups, and the share of letters among what is not white space; None if it has no letter."""
    import numpy as np

    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    known = letters()[points]
    if not known.any():
        return None
    share = known.sum() / (~spaces()[points]).sum()
    own = np.where(known, points, np.uint32(32))
    own = np.concatenate([[np.uint32(32)], own[(own != 32) | np.concatenate([[True], own[:-1] != 32])], [np.uint32(32)]])  # one gap for many
    a, b, c = (own * np.uint32(p) for p in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))  # fixed odd numbers that spread bits
    mix = lambda x: ((x ^ (x >> np.uint32(15))) * np.uint32(0x27D4EB2F)) >> np.uint32(20)  # noqa: E731  twelve bits: WIDTH
    counts = np.bincount(mix(a), minlength=WIDTH) + np.bincount(mix(a[:-1] + b[1:]), minlength=WIDTH)
    if len(own) > 2:
        counts = counts + np.bincount(mix(a[:-2] + b[1:-1] + c[2:]), minlength=WIDTH)
    return np.sqrt(counts / counts.sum()), float(share)


def features(text: str | None) -> np.ndarray | None:
    """Unit vector of the text's letter groups; None if it has no letter."""
    made = described(text)
    return None if made is None else made[0]


def fit(rows: np.ndarray, signs: np.ndarray, cost: float = COST) -> tuple[np.ndarray, np.ndarray]:
    """Weights (the last is the bias) of the squared hinge loss, by Newton steps over the rows inside the margin.

    And what each row gets from a fit without it: the rows outside the margin have no part in the fit, and for one
    inside, the step without it follows from the inverse of the last one.
    """
    import numpy as np

    kernel, alpha, inside = rows @ rows.T + 1.0, np.zeros(len(rows)), np.ones(len(rows), bool)
    for _ in range(50):
        at = np.flatnonzero(inside)
        alpha = np.zeros(len(rows))
        inner = kernel[np.ix_(at, at)] + np.eye(len(at)) / cost
        alpha[at] = np.linalg.solve(inner, signs[at])
        now = signs * (kernel @ alpha) < 1
        if (now == inside).all() or not now.any():
            break
        inside = now
    without = kernel @ alpha
    without[at] = signs[at] - alpha[at] / np.diag(np.linalg.inv(inner))
    return np.append(rows.T @ alpha, alpha.sum()), without


@dataclass
class Model:
    """One column of ``weights`` per family, then one per pair of languages of a family; one of ``logs`` per language.

    ``logs`` holds the log probabilities of the letter groups, ``likely`` the least mean of them a text of the language
    may have, ``margin`` and ``share`` the least margin and share of letters.
    """

    families: list[list[str]]
    pairs: list[tuple[str, str]]
    weights: np.ndarray
    logs: np.ndarray
    likely: dict[str, float]
    margin: float
    share: float

    def predict(self, text: str | None) -> tuple[str, float]:
        import numpy as np

        made = described(text) if self.families else None
        if made is None:
            return UNKNOWN, 0.0
        x, share = made
        lang, margin = self.told(x @ self.weights[:-1] + self.weights[-1])
        likely = x**2 @ self.logs[:, list(self.likely).index(lang)]
        spare = min(margin - self.margin, likely - self.likely[lang], share - self.share)
        return lang, float(1 / (1 + np.exp(-2 * spare)))

    def told(self, margins: np.ndarray) -> tuple[str, float]:
        """The language of the best family that wins most of its pairs, and its least margin; infinite for an only language."""
        import numpy as np

        own = margins[: len(self.families)]
        best = int(own.argmax())
        sure = own[best] - np.delete(own, best).max() if len(own) > 1 else np.inf
        votes = {lang: [0, 0.0] for lang in self.families[best]}
        for (a, b), m in zip(self.pairs, margins[len(self.families) :], strict=True):
            if a in votes and b in votes:
                for lang, won in ((a, m), (b, -m)):
                    votes[lang][0] += won > 0
                    votes[lang][1] += float(won)
        lang = max(sorted(votes), key=lambda v: votes[v])
        against = [m if a == lang else -m for (a, b), m in zip(self.pairs, margins[len(self.families) :], strict=True) if lang in (a, b)]
        return lang, float(min([sure, *against]))


def family_of(lang: str) -> str:
    return next((name for name, langs in FAMILIES.items() if lang in langs), lang)


def train(rows: np.ndarray, langs: list[str], shares: list[float]) -> Model:
    import numpy as np

    known, of = sorted(set(langs)), np.array(langs)
    families = [[x for x in known if family_of(x) == f] for f in sorted({family_of(x) for x in known})]
    columns, without = [], []
    for own in families:
        made = fit(rows, np.where(np.isin(of, own), 1.0, -1.0)) if len(families) > 1 else (np.zeros(WIDTH + 1), np.zeros(len(rows)))
        columns.append(made[0])
        without.append(made[1])
    pairs = [p for own in families for p in combinations(own, 2)]
    for a, b in pairs:
        at = np.isin(of, (a, b))
        weights, left = fit(rows[at], np.where(of[at] == a, 1.0, -1.0))
        columns.append(weights)
        without.append(rows @ weights[:-1] + weights[-1])
        without[-1][at] = left
    means = [(rows[of == lang] ** 2).mean(axis=0) for lang in known]
    logs = np.array([log_shares(m) for m in means]).T if known else np.zeros((WIDTH, 0))
    model = Model(families, pairs, np.array(columns).T.copy() if columns else np.zeros((WIDTH + 1, 0)), logs, dict.fromkeys(known, 0.0), 0.0, 0.0)
    if known:
        bounds(model, rows, langs, shares, np.array(without).T, dict(zip(known, means, strict=True)))
    return model


def log_shares(means: np.ndarray) -> np.ndarray:
    import numpy as np

    return np.log((means + SMOOTH / WIDTH) / (1 + SMOOTH))


def bounds(model: Model, rows: np.ndarray, langs: list[str], shares: list[float], margins: np.ndarray, means: dict[str, np.ndarray]) -> None:
    """Set the model's bounds by the right predictions that fits without the document make.

    A margin is clear from ``CLEAR`` of their median on. A language's texts are likely down to its median less ``REACH``
    times the distance of the low end from it (over all languages, equal texts once). Letters are rare below ``FEW`` of
    the low end.
    """
    import numpy as np

    n, seen = Counter(langs), {}
    for k, lang in enumerate(langs):
        told, margin = model.told(margins[k])
        if told == lang and margin > 0:
            share = rows[k] ** 2
            others = (means[lang] * n[lang] - share) / max(1, n[lang] - 1)
            seen.setdefault((lang, rows[k].tobytes()), (lang, margin, share @ log_shares(np.maximum(others, 0.0)), shares[k]))
    if not seen:
        model.likely = dict.fromkeys(model.likely, -np.inf)
        return
    right, margin, likely, share = (np.array(c) for c in zip(*seen.values(), strict=True))
    middle = {lang: np.median(likely[right == lang]) if (right == lang).any() else -np.inf for lang in model.likely}
    low = np.quantile(likely - np.array([middle[lang] for lang in right]), LOW)
    model.likely = {lang: float(m + REACH * low) for lang, m in middle.items()}
    model.margin = float(CLEAR * np.median(margin)) if np.isfinite(margin).all() else 0.0
    model.share = float(FEW * np.quantile(share, LOW))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Fit on about ``per_language`` documents of each language, picked by a hash of the doc_id among those not held out."""
    import numpy as np

    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counted = usable.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()
    if len(counted) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: pass documents whose lang is a language code")
    parts = 1 << 30
    share = F.lit(0)
    for r in counted:
        share = F.when(F.col("lang") == r["lang"], min(parts, parts * per_language // r["count"])).otherwise(share)
    picked = usable.where(F.pmod(F.xxhash64(F.lit("learn"), F.col("doc_id")), F.lit(parts)) < share)

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            made = [(lang, *x) for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True) if (x := described(text)) is not None]
            own = [pa.array([m[0] for m in made], pa.string()), pa.array([m[1].astype(np.float32).tobytes() for m in made], pa.binary()), pa.array([m[2] for m in made], pa.float64())]
            yield pa.RecordBatch.from_arrays(own, ["lang", "x", "share"])

    got = picked.select("lang", "text").mapInArrow(rows, "lang string, x binary, share double").collect()  # bounded by the sample
    got.sort(key=lambda r: (r["lang"], bytes(r["x"]), r["share"]))  # the same model, in whatever order the rows came
    return train(np.array([np.frombuffer(r["x"], np.float32) for r in got], np.float64).reshape(-1, WIDTH), [r["lang"] for r in got], [r["share"] for r in got])


def predictor(model: Model):
    @F.arrow_udf("struct<lang string, score double>")
    def predict(texts):
        import pyarrow as pa

        return pa.array([dict(zip(("lang", "score"), model.predict(t.as_py()))) for t in texts], pa.struct([("lang", pa.string()), ("score", pa.float64())]))

    return predict


def identify(docs: DataFrame, model: Model, result: str = "language") -> DataFrame:
    """``docs`` and the struct ``result`` of ``lang`` and ``score`` of each whole text."""
    return docs.withColumn(result, predictor(model)(F.col("text").cast("string")))


def keep_known(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The documents whose language is told with a score of ``least`` or more, with the columns they have.

    Below 0.5 a text is out of one of the learned bounds: not told clearly, unlike all of its language, or short of letters.
    """
    (own,) = unused(docs, "_language")
    told = identify(docs, model, own)
    return told.where((F.col(own)["lang"] != UNKNOWN) & (F.col(own)["score"] >= least)).drop(own)


@query("op7_language_id")
def op7(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    told = identify(docs.drop("lang"), learn(docs))
    return told.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))
