"""Language detection by character n-grams, learned from a table of texts.

A profile holds, of each language, how likely its most frequent runs of one to three letters are. A text belongs to the
language under which its runs are likeliest, unless they are less likely than runs of that language's own texts ever are: then
its language is none that the profile knows. Learning counts in Spark and brings a bounded table to the driver;
scoring is one pass in Arrow batches.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelex.functions.text import MIN_ENGLISH_CHARS, ascii_ratio
from tidelex.storage import cut

SIZES = (1, 2, 3)
#: Runs kept of each language, letters of a piece of text, and parts of the texts, of which each is told by the others.
PROFILE_RUNS, PIECE, FOLDS = 3000, 200, 3
#: The least standard deviation that a threshold is set by; few texts seem more alike than they are.
LEAST_SPREAD = 0.1
OTHER = "unknown"
_LETTERS = re.compile(r"[^\W\d_]+")


def letters(text: str) -> str:
    """The words of a lower-cased text, digits and signs left out, each between blanks."""
    words = _LETTERS.findall(text.lower())
    return f" {' '.join(words)} " if words else ""


def text_runs(text: str) -> list[str]:
    flat = letters(text)
    return [flat[i : i + n] for n in SIZES for i in range(len(flat) - n + 1) if flat[i : i + n] != " "]


def run_codes(flat: str) -> np.ndarray:
    """The runs of ``text_runs`` as numbers: 21 bits for each letter, the first one lowest."""
    c = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    two = c[:-1] | c[1:] << np.uint64(21)
    return np.concatenate([c[c != 32], two, two[:-1] | c[2:] << np.uint64(42)])


@dataclass(frozen=True)
class Profile:
    """Languages, the places of known runs, log-likelihoods (runs by languages; the last row is any other run) and the least mean of each language."""

    languages: list[str]
    places: dict[str, int]
    weights: np.ndarray
    least: np.ndarray

    def means(self, text: str) -> np.ndarray | None:
        """The mean log-likelihood of a text's runs under each language; None without letters."""
        flat = letters(text)
        if not flat or not self.languages:
            return None
        codes, place = self.codes
        found = run_codes(flat)
        at = np.minimum(np.searchsorted(codes, found), max(len(codes) - 1, 0))
        at = np.where(codes[at] == found, place[at], len(self.places)) if len(codes) else np.zeros(len(found), np.int64)
        return np.bincount(at, minlength=len(self.places) + 1) @ self.weights / len(found)

    @cached_property
    def codes(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted codes of the known runs, and their places."""
        codes = np.array([int(run_codes(r)[-1]) for r in self.places], np.uint64)
        order = np.argsort(codes)
        return codes[order], np.array(list(self.places.values()), np.int64)[order]

    def language(self, text: str | None) -> str | None:
        """The text's language, ``OTHER`` if it is none of the profile's, None for a text without letters."""
        means = self.means(text or "")
        if means is None:
            return None
        best = int(np.argmax(means))
        return self.languages[best] if means[best] >= self.least[best] else OTHER


def learn(texts: DataFrame, text: str = "text", language: str = "lang", runs: int = PROFILE_RUNS, tolerance: float = 5.0) -> Profile:
    """A profile from (text, language) rows; rows with a null in either teach nothing, an empty table knows no language.

    Counts cover all rows; what comes to the driver is bounded by ``runs`` of each language. A language's threshold lies
    ``tolerance`` standard deviations below the mean of the pieces of all its texts, each under a profile of other texts: the
    texts are dealt to FOLDS parts by a hash, and a part is told by the others. A language with texts in one part only has none.
    """
    fold = lambda t: zlib.crc32(t.encode("utf-8", "surrogatepass")) % FOLDS
    known = texts.where(F.col(text).isNotNull() & F.col(language).isNotNull()).select(F.col(language).cast("string").alias("language"), F.col(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held: dict[tuple[str, int], Counter[str]] = {}
            for lang, t in zip(b["language"].to_pylist(), b["text"].to_pylist(), strict=True):
                held.setdefault((lang, fold(t)), Counter()).update(text_runs(t))
            columns = list(zip(*[(lang, r, k, n) for (lang, k), runs in held.items() for r, n in runs.items()], strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_pydict({"language": pa.array(columns[0], pa.string()), "run": pa.array(columns[1], pa.string()), "fold": pa.array(columns[2], pa.int32()), "n": pa.array(columns[3], pa.int64())})

    names = ["n", *(f"without{k}" for k in range(FOLDS))]
    apart = [F.coalesce(F.sum(F.when(F.col("fold") != k, F.col("n"))), F.lit(0)).alias(names[k + 1]) for k in range(FOLDS)]
    counts = cut(known.mapInArrow(count, "language string, run string, fold int, n long").groupBy("language", "run").agg(F.sum("n").alias("n"), *apart))
    total = {r.language: r for r in counts.groupBy("language").agg(*[F.sum(x).alias(x) for x in names]).collect()}
    top = counts.withColumn("at", F.row_number().over(Window.partitionBy("language").orderBy(F.desc("n"), "run"))).where(F.col("at") <= runs)
    rows = top.select("language", "run", *names).collect()
    languages, places = sorted(total), {r: i for i, r in enumerate(sorted({x.run for x in rows}))}

    def likelihoods(column: str) -> np.ndarray:
        weights = np.zeros((len(places) + 1, len(languages)))
        for x in rows:
            weights[places[x.run], languages.index(x.language)] = x[column]
        held = weights.sum(axis=0)
        for k, lang in enumerate(languages):  # runs that the profile lacks share what is left over
            whole = total[lang][column]
            weights[:, k] = np.log((weights[:, k] + 0.5) / (whole + 0.5 * (len(places) + 1)))
            weights[-1, k] = math.log(max(whole - held[k], 0.5) / (whole + 1) / 10)
        return weights

    if not languages:
        return Profile([], {}, np.zeros((1, 0)), np.zeros(0))
    others = [Profile(languages, places, likelihoods(x), np.full(len(languages), -np.inf)) for x in names[1:]]
    taught = {(lang, k) for lang in languages for k in range(FOLDS) if total[lang][names[k + 1]]}

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[str, float]] = []
            for lang, t in zip(b["language"].to_pylist(), b["text"].to_pylist(), strict=True):
                k = fold(t)
                flat = letters(t) if (lang, k) in taught else ""
                at = languages.index(lang)
                for i in range(0, max(1, len(flat) - PIECE // 2), PIECE):
                    if (means := others[k].means(flat[i : i + PIECE])) is not None:
                        out.append((lang, float(means[at])))
            yield pa.RecordBatch.from_pydict({"language": pa.array([x[0] for x in out], pa.string()), "mean": pa.array([x[1] for x in out], pa.float64())})

    found = known.mapInArrow(spread, "language string, mean double").groupBy("language").agg(F.avg("mean").alias("mean"), F.stddev_pop("mean").alias("sd")).collect()
    least = {r.language: r["mean"] - tolerance * max(r.sd, LEAST_SPREAD) for r in found}
    return Profile(languages, places, likelihoods("n"), np.array([least.get(x, -np.inf) for x in languages]))


def language_of(text: Column, profile: Profile) -> Column:
    """The language of a text by the profile, ``unknown`` for any other, null for null texts and texts without letters."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(profile.language)

    return F.pandas_udf(run, "string")(text)


def is_english(text: Column, profile: Profile, min_chars: int = MIN_ENGLISH_CHARS) -> Column:
    """Texts under ``min_chars`` pass; below 85 % ASCII fails; then the profile decides, and 92 % ASCII where there are no letters."""
    return passes_as_english(text, language_of(text, profile), min_chars)


def passes_as_english(text: Column, found: Column, min_chars: int = MIN_ENGLISH_CHARS) -> Column:
    """``is_english`` of a text whose language has been ``found``."""
    t = F.trim(text)
    return F.when(F.length(t) < min_chars, F.lit(True)).when(ascii_ratio(t) < 0.85, F.lit(False)).when(found.isNull(), ascii_ratio(t) >= 0.92).otherwise(found == "en")
