"""Which documents share most distinct words with each of many word sets, block by block (see ``blocks``).

A task holds one bounded block of documents and one of sets.  Frequent words are rows of bytes there, rare ones lists of
places, so a set costs a few additions at the places of its rare words and no pair of a set and a document is ever a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docweft.durable import stored
from docweft.operators import blocks
from docweft.session import ships

#: Documents, and characters of documents, in a block; word sets in a block.
DOC_BLOCK, CHAR_BLOCK, SET_BLOCK = 1 << 15, 1 << 25, 1 << 17
#: A word that more than one in so many documents of a block have is frequent and kept as a row of bytes.
DENSE = 32


def block_sizes(docs: DataFrame, text: str, queries: DataFrame, doc_block: int, char_block: int, query_block: int = blocks.QUERY_BLOCK) -> DataFrame:
    """One row ``__db, __qb`` for ``blocks.paired``: as many blocks as keep to these numbers on average."""
    db = F.ceil(F.greatest(F.count(F.lit(1)) / F.lit(doc_block), F.coalesce(F.sum(F.length(text)), F.lit(0)) / F.lit(char_block)))
    return docs.agg(db.alias("__db")).crossJoin(F.broadcast(queries.agg(F.ceil(F.count(F.lit(1)) / F.lit(query_block)).alias("__qb"))))


def _most(total: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` largest numbers above 0, equal ones from the last place on."""
    low = int(total.max())
    if low == 0:
        return np.zeros(0, np.int64)
    while low > 1 and np.count_nonzero(total >= low) < n:
        low -= 1
    above = np.flatnonzero(total > low)[::-1]
    above = above[np.argsort(-total[above].astype(np.int64), kind="stable")]
    return np.concatenate([above, np.flatnonzero(total == low)[::-1][: max(0, n - len(above))]])[:n]


def _lists(has: tuple[np.ndarray, np.ndarray], n_docs: int, asked: tuple[np.ndarray, np.ndarray], n: int) -> tuple[np.ndarray, ...]:
    """Arrays ``set, document, shared``: of each set the ``n`` documents that share most words, equal ones from the last on.  ``has`` are words and the
    documents that have them, ``asked`` words and the sets that ask for them, set by set.

    Sets with the same frequent words share one count of those.
    """
    (word, at), (want, owner) = has, asked
    terms, number = np.unique(want, return_inverse=True)
    t = np.minimum(np.searchsorted(terms, word), len(terms) - 1)
    mine = terms[t] == word
    pairs = np.sort(t[mine] * n_docs + at[mine])
    pairs = pairs[np.diff(pairs, prepend=-1) > 0]  # a document that comes in several rows has a word once
    edge = np.searchsorted(pairs, np.arange(len(terms) + 1) * n_docs)
    at, df = pairs % n_docs, np.diff(edge)
    lots = np.flatnonzero(df * DENSE > n_docs)
    rows = np.zeros((len(lots), n_docs), np.uint8)
    for i, k in enumerate(lots.tolist()):
        rows[i, at[edge[k]:edge[k + 1]]] = 1
    slot = np.full(len(terms), -1)
    slot[lots] = np.arange(len(lots))
    met = df[number] > 0
    number, owner = number[met], owner[met]
    cut = np.r_[0, np.flatnonzero(np.diff(owner)) + 1, len(owner)].tolist() if len(owner) else [0]
    alike: dict[bytes, list[tuple[int, np.ndarray]]] = {}
    for a, b in zip(cut, cut[1:]):
        s = slot[number[a:b]]
        alike.setdefault(np.sort(s[s >= 0]).tobytes(), []).append((a, number[a:b][s < 0]))
    out = []
    for frequent, sets in alike.items():
        f = np.frombuffer(frequent, slot.dtype).tolist()
        base = np.zeros(n_docs, np.uint8 if len(f) + max(len(rare) for _, rare in sets) < 256 else np.int32)
        for i in f:
            base += rows[i]
        same = None  # the list of the sets that have no rare word
        for a, rare in sets:
            if len(rare):
                total = base.copy()
                for k in rare.tolist():
                    total[at[edge[k]:edge[k + 1]]] += 1
                best = _most(total, n)
                shared = total[best]
            else:
                same = _most(base, n) if same is None else same
                best, shared = same, base[same]
            out.append((np.full(len(best), owner[a]), best, shared.astype(np.int64)))
    return tuple(map(np.concatenate, zip(*out))) if out else (np.zeros(0, np.int64),) * 3


def most_shared(want: DataFrame, docs: DataFrame, n: int, key: str, doc: str, text: str, words: str, doc_block: int = DOC_BLOCK) -> DataFrame:
    """``key, doc, overlap, place``: for each key of ``want`` (``key, tok``) the ``n`` documents of ``docs`` (``doc, text, words``) that share most of
    its distinct words, ties to the larger id.  Documents that share none are not ranked.  Words, and sets of them, are told apart by 64-bit hashes.
    """
    sets = stored(want.groupBy(key).agg(F.array_sort(F.collect_set(F.xxhash64("tok"))).alias("__t")).withColumn("__s", F.xxhash64("__t")))
    once = sets.select("__s", "__t").dropDuplicates(["__s"])
    known = docs.select(doc, F.transform(words, lambda w: F.xxhash64(w)).alias("__h"))
    kind = docs.schema[doc].dataType.simpleString()

    def run(d: pa.Table, q: pa.Table) -> pa.Table:
        ids, which, best, shared = d.column(doc).slice(0, 0).combine_chunks(), *[np.zeros(0, np.int64)] * 3
        if d.num_rows and q.num_rows:
            ids, at = blocks.ids_in_order(d.column(doc))
            each = lambda x, of: (x.flatten().to_numpy(zero_copy_only=False), np.repeat(of, pc.list_value_length(x).to_numpy(zero_copy_only=False)))
            has, asked = each(d.column("__h").combine_chunks(), at), each(q.column("__t").combine_chunks(), np.arange(q.num_rows))
            which, best, shared = _lists(has, len(ids), asked, n)
        return pa.table([q.column("__s").take(pa.array(which)), ids.take(pa.array(best)), pa.array(shared)], names=["__s", doc, "overlap"])

    lists = blocks.paired(known, once, doc, "__s", block_sizes(docs, text, once, doc_block, CHAR_BLOCK, SET_BLOCK), run, f"__s bigint, `{doc}` {kind}, overlap bigint")
    w = W.partitionBy("__s").orderBy(F.col("overlap").desc(), F.col(doc).desc())
    ranked = lists.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
    return sets.select(key, "__s").join(ranked, "__s").select(key, doc, "overlap", "place")


ships(__name__)
