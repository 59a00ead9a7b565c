"""Mixing sources to target shares of the tokens.

One pass counts tokens by source and by ranges of a seeded hash of the document id.  From that
small table come the repetition rate of each source and a threshold.  A second pass emits every
document ``floor(rate)`` times, and once more if its hash falls under the threshold; no shuffle.
"""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docweft.llm._util import ships

#: The vocabulary file is a parameter; this is its place on the test machine.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Ranges of the document hash for which tokens are counted.
RANGES = 8192
MAX_SOURCES = 10_000


def source_key(source: Column) -> Column:
    """Spelling variants of a source agree: lower case, blanks at the ends dropped, hyphens and blanks inside as underscores."""
    return F.regexp_replace(F.lower(F.trim(source)), "[-\\s]+", "_")


def token_counter(vocabulary: str = VOCABULARY):
    """A UDF that counts tokens of a public byte-level vocabulary; null texts have 0.  Loaded once per worker."""
    loaded: dict = {}

    def count(texts):
        if "e" not in loaded:
            import tiktoken

            with open(vocabulary, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            loaded["e"] = tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        e = loaded["e"]
        return pa.array([0 if t is None else len(e.encode_ordinary(t)) for t in texts.to_pylist()], type=pa.int64())

    return F.arrow_udf(count, "long")


def document_hash(doc: Column, seed: int) -> Column:
    """A number from 0 to 2**53 - 1, even over documents, the same in every run."""
    return F.pmod(F.xxhash64(doc, F.lit(seed)), F.lit(1 << 53))


def usable(documents: DataFrame, doc: str, source: str, text: str) -> DataFrame:
    return documents.where(F.col(doc).isNotNull() & F.col(source).isNotNull() & F.col(text).rlike(r"\S"))


def source_rates(documents: DataFrame, targets: DataFrame, doc: str = "doc_id", source: str = "source", text: str = "text", seed: int = 7,
                 total_tokens: float | None = None, counter=None) -> DataFrame:
    """A row per target: ``source, target_share, max_repeats, n_tokens, rate, whole, threshold, mixed_tokens, actual_share``.

    Without ``total_tokens`` the mixture is the largest in which every source reaches its share
    under its cap; with it, sources that meet their cap stay there and fall short.  The extra copy's
    probability is the fraction of the rate, moved by less than one hash range to the nearest
    token count that can be reached.  Sources without tokens get rate 0 and take no part in the size.
    """
    counter = counter or token_counter()
    t = (targets.where(F.col("source").isNotNull()).groupBy(source_key(F.col("source")).alias("source"))
         .agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")))
    part = F.floor(document_hash(F.col(doc), seed) / F.lit((1 << 53) // RANGES)).cast("int")
    ranges = (usable(documents, doc, source, text).select(source_key(F.col(source)).alias("source"), part.alias("part"), counter(F.col(text)).alias("n"))
              .groupBy("source", "part").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs")))
    ranges = ranges.join(t.select("source"), "source", "left_semi")
    sizes = t.join(ranges.groupBy("source").agg(F.sum("n").alias("n_tokens"), F.sum("docs").alias("n_docs")), "source", "left").na.fill(0, ["n_tokens", "n_docs"])
    has = F.when((F.col("n_tokens") > 0) & (F.col("target_share") > 0), F.col("n_tokens") * F.col("max_repeats") / F.col("target_share"))
    sizes = sizes.withColumn("__room", has)
    if total_tokens is None:
        sizes = sizes.crossJoin(F.broadcast(sizes.agg(F.min("__room").alias("__total"))))
    else:
        sizes = sizes.withColumn("__total", F.lit(float(total_tokens)))
    rate = F.when(F.col("n_tokens") > 0, F.least(F.col("max_repeats").cast("double"), F.col("__total") * F.col("target_share") / F.col("n_tokens"))).otherwise(F.lit(0.0))
    sizes = sizes.withColumn("rate", F.round(rate, 9)).withColumn("whole", F.floor("rate").cast("int"))
    w = W.partitionBy("source").orderBy("part")
    cum = (ranges.withColumn("upto", F.sum("n").over(w)).select("source", (F.col("part") + 1).alias("edge"), "upto")
           .unionByName(sizes.select("source", F.lit(0).alias("edge"), F.lit(0).cast("long").alias("upto"))))
    want = (F.col("rate") - F.col("whole")) * F.col("n_tokens")
    edge = (cum.join(F.broadcast(sizes.select("source", "rate", "whole", "n_tokens")), "source")
            .groupBy("source").agg(F.min(F.struct(F.abs(F.col("upto") - want).alias("off"), F.when(F.col("rate") > F.col("whole"), F.col("edge")).otherwise(F.lit(0)).alias("edge"), F.when(F.col("rate") > F.col("whole"), F.col("upto")).otherwise(F.lit(0)).alias("upto"))).alias("b")))
    out = (sizes.join(edge, "source", "left")
           .withColumn("threshold", F.coalesce(F.col("b.edge"), F.lit(0)).cast("long") * F.lit((1 << 53) // RANGES))
           .withColumn("mixed_tokens", (F.col("whole") * F.col("n_tokens") + F.coalesce(F.col("b.upto"), F.lit(0))).cast("long")))
    every = out.agg(F.sum("mixed_tokens").alias("__all"))
    return (out.crossJoin(F.broadcast(every)).withColumn("actual_share", F.when(F.col("__all") > 0, F.col("mixed_tokens") / F.col("__all")).otherwise(F.lit(0.0)))
            .select("source", "target_share", "max_repeats", "n_docs", "n_tokens", "rate", "whole", "threshold", "mixed_tokens", "actual_share"))


def mix(documents: DataFrame, targets: DataFrame, doc: str = "doc_id", source: str = "source", text: str = "text", seed: int = 7,
        total_tokens: float | None = None, counter=None) -> DataFrame:
    """The mixture: all columns of ``documents`` with ``mix_source`` and ``copy_no`` from 1, a row per copy.

    Documents with null id, null source, null or blank text, or a source without target are in no
    mixture.  A document is used at most its source's ``max_repeats`` times.  Input columns
    named like the new ones are replaced.  The rates, one row per target, are broadcast if there are at most ``MAX_SOURCES`` of them, else joined.
    """
    bounded = F.broadcast if targets.limit(MAX_SOURCES + 1).count() <= MAX_SOURCES else lambda df: df
    rates = source_rates(documents, targets, doc, source, text, seed, total_tokens, counter).select(F.col("source").alias("mix_source"), "whole", "threshold")
    keep = [c for c in documents.columns if c not in ("mix_source", "copy_no")]
    docs = usable(documents, doc, source, text).select(*keep).withColumn("mix_source", source_key(F.col(source)))
    rates = rates.select("mix_source", F.col("whole").alias("__whole"), F.col("threshold").alias("__threshold"))
    copies = F.col("__whole") + (document_hash(F.col(doc), seed) < F.col("__threshold")).cast("int")
    return (docs.join(bounded(rates), "mix_source").withColumn("__n", copies).where("__n > 0")
            .withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("__n")))).drop("__whole", "__threshold", "__n").select(*keep, "mix_source", "copy_no"))


ships(__name__)
