"""Languages of short texts by character trigrams, learned from labelled documents.

A profile is a table of log probabilities of hashed trigrams by language.  Each language's counts are drawn
towards the mean of all languages, so trigrams that were hardly seen, as those of names, say nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweft.llm._util import ships

BUCKETS = 1 << 15
#: Documents the profiles are learned from, about so many, picked by a hash of their id: the documented bound of the fit.
SAMPLE_DOCUMENTS = 6000
#: A label counts as a language if it has at least this share of the sample, so there are at most ``1 / LEAST_SHARE`` profiles.
LEAST_SHARE = 0.002
#: Occurrences that pull a language's trigrams towards the mean of all.
STRENGTH = 8000.0

NOT_LETTERS = re.compile(r"[\W\d_]+")


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of the letters of all texts, blanks between words, and how many each text has."""
    bare = [f" {NOT_LETTERS.sub(' ', t.lower()).strip()} " for t in texts]
    sizes = np.array([max(0, len(t) - 2) for t in bare], dtype=np.int64)
    x = np.frombuffer("".join(bare).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    if len(x) < 3:
        return np.zeros(0, dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
    h = (x[:-2] * np.uint64(0x9E3779B97F4A7C15) + x[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + x[2:] * np.uint64(0x165667B19E3779F9)) >> np.uint64(64 - 15)
    inside = np.ones(len(x), dtype=bool)
    ends = np.cumsum([len(t) for t in bare])
    inside[ends - 1] = inside[ends - 2] = False  # trigrams that would reach into the next text
    return h[inside[:-2]].astype(np.int64), sizes


@dataclass
class LanguageProfiles:
    """``weights[trigram, language]``: log probabilities; without languages every score is empty."""

    names: list[str]
    weights: np.ndarray

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of every text in every language, and its number of trigrams."""
        h, sizes = trigrams(texts)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        out = np.zeros((len(texts), len(self.names)))
        for k in range(len(self.names)):
            sums = np.concatenate([[0.0], np.cumsum(self.weights[:, k][h], dtype=np.float64)])
            out[:, k] = sums[starts[1:]] - sums[starts[:-1]]
        return out, sizes


def learn(documents: DataFrame, doc: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE_DOCUMENTS) -> LanguageProfiles:
    """Profiles of the languages that documents are labelled with.

    Labels are compared in lower case up to the first hyphen; null ones and ``und`` are none.  Wrong labels only blur a profile.
    What reaches the driver is one row per language and trigram bucket.
    """
    of = 1 << 20
    some = max(1, min(of, round(of * sample / max(1, documents.count()))))
    label = F.regexp_extract(F.lower(F.trim(F.col(lang))), "^([a-z]{2,3})(?:[-_].*)?$", 1)
    picked = documents.where((F.pmod(F.xxhash64(doc), F.lit(of)) < some) & F.col(text).isNotNull()).select(label.alias("l"), F.col(text).alias("t")).where("l <> '' and l <> 'und'")

    def run(batches):
        for b in batches:
            by: dict[str, list[str]] = {}
            for name, t in zip(*(c.to_pylist() for c in b.columns)):
                by.setdefault(name, []).append(t)
            for name, texts in by.items():
                at, n = np.unique(trigrams(texts)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(n), pa.array([len(texts)] + [0] * (len(at) - 1) if len(at) else [], pa.int64())], names=["l", "b", "n", "docs"])

    rows = picked.mapInArrow(run, "l string, b long, n long, docs long").groupBy("l", "b").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    totals = rows.groupBy("l").agg(F.sum("docs").alias("d"))
    every = totals.agg((F.sum("d") * F.lit(LEAST_SHARE)).alias("least"))
    kept = totals.crossJoin(F.broadcast(every)).where("d >= least").select("l")
    got = rows.join(F.broadcast(kept), "l").select("l", "b", "n").toPandas()
    names = sorted(got["l"].unique())
    if not names:
        return LanguageProfiles([], np.zeros((BUCKETS, 0), dtype=np.float32))
    counts = np.zeros((BUCKETS, len(names)))
    counts[got["b"].to_numpy(), got["l"].map({n: k for k, n in enumerate(names)}).to_numpy()] = got["n"].to_numpy()
    share = (counts + 0.01) / (counts + 0.01).sum(0)
    mean = share.mean(1, keepdims=True)
    return LanguageProfiles(names, np.log((counts + STRENGTH * mean) / (counts.sum(0) + STRENGTH)).astype(np.float32))


ships(__name__)
