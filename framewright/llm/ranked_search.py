"""Ranked lexical search by NRA: sequential reads of impact-sorted lists, score intervals, no random access.

Documents are dealt into shards of about ``ENTRIES`` (document, term) entries by hash.  A shard turns its entries into one
list per term, highest impact first.  For an item it reads on in all of the item's lists, a block at a time: what a document
has collected is the lower end of its score, and the impacts at which the unread lists stand bound what it may still get.
Reading ends when the 50th lower end exceeds all that unseen documents can reach and every document that could still be
among the best has its final score.  The best of all shards meet per item, in two steps.

Documents are tokenised once.  A filter of fixed size (``BITS`` bits, set by the items' terms) drops most other terms there;
what passes by accident finds no list, so the filter decides nothing.  Items are searched in blocks of about ``ITEMS``.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.llm.base import byte_texts, chunks
from framewright.session import written

BITS, ENTRIES, ITEMS = 1 << 20, 1 << 20, 256
_READ = 256  # postings of a list in the first block; each further block doubles

# Bytes of terms (digits, letters, all beyond ASCII) with A-Z lower-cased; any other byte separates.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in chunks(batches, "text"):
        found = [sorted(set(terms_of(t))) for t in byte_texts(rows.column("text"))]
        yield pa.RecordBatch.from_arrays([rows.column("item"), pa.array(found, pa.list_(pa.binary()))], names=["item", "terms"])


def _doc_terms(bits: bytes):
    wanted = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little").astype(bool).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in chunks(batches, "text"):
            n, sizes, terms, counts = [], [0], [], []
            for text in byte_texts(rows.column("text")):
                found = terms_of(text)
                n.append(len(found))
                for term, tf in Counter(found).items():
                    if wanted[zlib.crc32(term) % BITS]:
                        terms.append(term)
                        counts.append(tf)
                sizes.append(len(terms))
            ends = pa.array(sizes, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [rows.column("key"), pa.array(n, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(terms, pa.binary())),
                 pa.ListArray.from_arrays(ends, pa.array(counts, pa.int64()))], names=["key", "n", "terms", "tfs"])

    return run


def nra(lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int, k: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of the ``k`` best sums above 0, highest first, ties by ``rank`` (a number per document).

    ``lists`` are (documents, impacts) with falling impacts; a document is in a list at most once.
    """
    low, seen = np.zeros(n_docs, np.int64), np.zeros((n_docs, len(lists)), bool)
    bound = np.array([w[0] if len(w) else 0 for _, w in lists], np.int64)
    at, block = 0, _READ
    while True:
        for j, (docs, impacts) in enumerate(lists):
            if bound[j]:
                new = docs[at:at + block]
                low[new] += impacts[at:at + block]
                seen[new, j] = True
                bound[j] = impacts[at + block] if at + block < len(impacts) else 0
        at, block = at + block, 2 * block
        if bound.any():
            # A document's interval is [low, low + what it may get from lists in which it has not been seen].
            kth = np.partition(low, n_docs - k)[n_docs - k] if n_docs > k else 0
            if kth <= bound.sum():
                continue
            near = np.nonzero(low + bound.sum() >= kth)[0]
            open_sum = (~seen[near]) @ bound
            if (open_sum[low[near] + open_sum >= kth] > 0).any():
                continue
        best = np.nonzero(low > 0)[0]
        best = best[np.lexsort((rank[best], -low[best]))][:k]
        return best, low[best]


def _searched(k: int, docs_all: int, terms_all: int):
    def run(docs: pa.Table, items: pa.Table) -> pa.Table:
        docs, items = docs.combine_chunks(), items.combine_chunks()
        found: list[tuple[np.ndarray, ...]] = []
        if docs.num_rows and items.num_rows:
            one = lambda c: c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
            pairs = one(items.column("term"))
            vocabulary = pc.unique(pairs)
            terms = one(docs.column("terms"))
            code = pc.fill_null(pc.index_in(terms.flatten(), value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(docs.num_rows), pc.list_value_length(terms).to_numpy(zero_copy_only=False))
            tf, n = one(docs.column("tfs")).flatten().to_numpy(), one(docs.column("n")).to_numpy()
            mine = pc.index_in(pairs, value_set=vocabulary).to_numpy(zero_copy_only=False)
            weight = np.zeros(len(vocabulary), np.int64)
            weight[mine] = one(items.column("w")).to_numpy()
            m = 50 + 50 * n * docs_all // terms_all
            hit = code >= 0
            code, doc, tf = code[hit], doc[hit], tf[hit]
            impact = weight[code] * (1_000_000_000 * tf // (1000 * tf + 20 * m[doc]))
            order = np.lexsort((doc, -impact, code))
            code, doc, impact = code[order], doc[order], impact[order]
            begin = np.searchsorted(code, np.arange(len(vocabulary) + 1))
            # Ties go by key, nulls first, then by place in the shard; equal keys are told apart only by their order.
            keys = one(docs.column("key"))
            rank = np.empty(docs.num_rows, np.int64)
            rank[pc.sort_indices(keys, null_placement="at_start").to_numpy()] = np.arange(docs.num_rows)
            who = one(items.column("item_no")).to_numpy()
            by_item = np.argsort(who, kind="stable")
            for part in np.split(by_item, np.nonzero(np.diff(who[by_item]))[0] + 1):
                lists = [(doc[begin[t]:begin[t + 1]], impact[begin[t]:begin[t + 1]]) for t in mine[part]]
                best, score = nra([x for x in lists if len(x[0])], docs.num_rows, k, rank)
                found.append((np.full(len(best), who[part[0]]), best, score))
        cat = lambda i, kind: np.concatenate([f[i] for f in found]).astype(kind) if found else np.zeros(0, kind)
        key = docs.column("key").take(pa.array(cat(1, np.int64)))
        return pa.table({"item_no": cat(0, np.int64), "key": key, "score": cat(2, np.int64)})

    return run


def ranked(docs: DataFrame, items: DataFrame, k: int = 50, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """(item, rank, key, score): the ``k`` highest-scoring documents of each item with a score above 0, equal scores by ascending key.

    A text that is null or without a term has no part on either side.  Items that share an id are one item with all their terms;
    so are items with a null id.  A repeated document is a document of its own and gets its own rank; null keys come first among
    equal scores.  Without documents or items the result is empty.
    """
    spark = docs.sparkSession
    kind, name = docs.schema[key].dataType.simpleString(), items.schema[item].dataType.simpleString()
    asked = items.select(F.col(item).alias("item"), F.col(text).alias("text")).mapInArrow(_item_terms, f"item {name}, terms array<binary>")
    pairs = written(asked.select("item", F.explode("terms").alias("term")).distinct(), "ranked-terms")
    slots = [r.s for r in pairs.select((F.crc32("term") % BITS).cast("int").alias("s")).distinct().collect()]  # at most BITS numbers
    bits = np.zeros(BITS, np.uint8)
    bits[slots] = 1

    spots = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        _doc_terms(np.packbits(bits, bitorder="little").tobytes()), f"key {kind}, n long, terms array<binary>, tfs array<long>").where("n > 0")
    spots = written(spots.withColumn("u", F.monotonically_increasing_id()), "ranked-docs")
    whole = spots.agg(F.count("*").alias("n"), F.sum("n").alias("l"), F.sum(F.size("terms")).alias("e")).first()
    n, total = whole.n, whole.l or 1
    shards = max(1, -(-(whole.e or 0) // ENTRIES))

    df = spots.select(F.explode("terms").alias("term")).groupBy("term").count()
    ids = pairs.select("item").distinct()
    blocks = max(1, -(-ids.count() // ITEMS))
    numbered = written(ids.select("item", F.monotonically_increasing_id().alias("item_no")), "ranked-items")
    weights = pairs.join(df, "term").select("item", "term", F.floor(1000 * F.log(F.lit(2.0 * n + 2) / (2.0 * F.col("count") + 1))).cast("long").alias("w"))
    lookup = weights.join(numbered, weights["item"].eqNullSafe(numbered["item"])).select(
        "item_no", "term", "w", F.pmod(F.xxhash64("item_no"), F.lit(blocks)).cast("int").alias("block"))

    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    tasks = max(shards * blocks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    at = ["block", "shard"]
    dealt = spots.withColumn("shard", F.pmod(F.xxhash64("u"), F.lit(shards)).cast("int")).withColumn("block", every(blocks)).drop("u")
    sent = lookup.withColumn("shard", every(shards))
    found = dealt.repartition(tasks, *at).groupBy(*at).cogroup(sent.repartition(tasks, *at).groupBy(*at)).applyInArrow(
        _searched(k, n, total), f"item_no long, key {kind}, score long")
    by = [F.col("score").desc(), F.col("key").asc_nulls_first()]
    some = Window.partitionBy("item_no", F.pmod(F.xxhash64("key", "score"), F.lit(32))).orderBy(*by)
    last = Window.partitionBy("item_no").orderBy(*by)
    best = found.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= k).withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
    return best.join(numbered, "item_no").select(F.col("item").alias(item), F.col("rank").cast("int").alias("rank"), F.col("key").alias(key), "score")


def twin_sql(k: int = 50) -> str:
    """The same in DuckDB."""
    words = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""WITH d AS (SELECT row_number() OVER () AS u, doc_id, {words} AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT u, doc_id, len(w)::BIGINT AS n, w FROM d WHERE len(w) > 0), whole AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM s),
tf AS (SELECT u, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT u, doc_id, n, unnest(w) AS term FROM s) GROUP BY ALL),
df AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term), q AS (SELECT DISTINCT item_id, unnest({words}) AS term FROM benchmark WHERE text IS NOT NULL),
sc AS (SELECT item_id, u, doc_id, sum(floor(1000 * ln((2.0::DOUBLE * nn + 2) / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll))))::BIGINT AS score
  FROM q JOIN df USING (term) JOIN tf USING (term), whole GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM sc WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= {k}"""
