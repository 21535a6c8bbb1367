"""Ranked lexical search over an inverted index.

Terms are the maximal runs of ASCII letters and digits and of all characters beyond
ASCII, with A-Z lower-cased. `build` writes the index: a posting (bucket, term, row,
doc_id, tf, n, head) for every term of every document, in segments. A segment is what
one task reads of the documents, so nothing is shuffled and a frequent term is spread over
all segments; inside a segment postings are sorted by the bucket of their term and the
term, so a search skips the row groups that hold none of its buckets. `row` names a
document in the index, n is its number of terms and head marks one posting a document,
from which the totals are summed.

`search` joins the terms of the items to the postings, deals the postings that are met (not the
matches, of which there are many more) by document, scores each match in 64-bit integers, sums
by item and document where they lie, and numbers each item's best by a window, which keeps no
more than `top` rows an item and task before they are shuffled. Item terms are broadcast up
to BROADCAST_ROWS of them, counted first, and joined by shuffle beyond that.

Weights: a term that df of N documents hold weighs w = floor(1000 ln((2N+2)/(2df+1))). A
document of n terms, where all have L, has m = 100 - B + (B*n*N) div L, and a match gives
w * ((10^9 tf) div (1000 tf + 8 m)).

Defined cases: a null text, or one without a term, is no document and is never found. Every row of
documents is a document of its own, repeated ids and null ids included; equal scores are
ranked by doc_id, nulls last. Rows of items with one id are one item with the terms of
all; a null id is an item. Items without a term that scores have no rows. Columns of other names
are left aside.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terravia.llm.common import discard, fresh_path, kept, table

_TERM = re.compile(rb"[0-9a-z\x80-\xFF]+")
#: The same in SQL, for lower-cased text.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BUCKETS = 1024
TOP = 10
#: Percent of the weight of a document's length.
B = 75
#: Item terms (item, term) that are broadcast at most; some 50 bytes each.
BROADCAST_ROWS = 200_000
#: Postings that a task hands on at a time.
HELD = 1 << 17


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in UTF-8; bytes.lower() folds A-Z alone, and every byte of a character beyond ASCII is over 0x7F."""
    return _TERM.findall((text or "").encode("utf-8", "surrogatepass").lower())


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, owners, times, lengths, texts = [], [], [], [], batch.column("text")

        def made(at: int, batch=batch, found=found, owners=owners, times=times, lengths=lengths) -> pa.RecordBatch:
            sizes = np.array(owners, dtype=np.int64)
            owner = np.repeat(np.arange(at - len(sizes), at), sizes)
            heads = np.zeros(len(owner), dtype=bool)
            heads[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
            taken = pa.array(owner)
            term = pa.array(found, pa.binary()).cast(pa.string())
            columns = [term, batch.column("row").take(taken), batch.column("doc_id").take(taken), pa.array(times, pa.int32()), pa.array(np.repeat(lengths, sizes), pa.int32()), pa.array(heads)]
            return pa.RecordBatch.from_arrays(columns, ["term", "row", "doc_id", "tf", "n", "head"])

        for i in range(batch.num_rows):
            terms = terms_of(texts[i].as_py())
            counts = Counter(terms)
            found += counts
            times += counts.values()
            owners.append(len(counts))
            lengths.append(len(terms))
            if len(found) >= HELD:
                yield made(i + 1)
                for held in (found, owners, times, lengths):
                    held.clear()
        if owners:
            yield made(batch.num_rows)


def bucket(term: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def postings(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, term, row, doc_id, tf, n, head, sorted by bucket and term inside each partition. docs: doc_id, text."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    each = rows.mapInArrow(_posted, "term string, row long, doc_id long, tf int, n int, head boolean")
    return each.select(bucket(F.col("term"), buckets).alias("bucket"), "*").sortWithinPartitions("bucket", "term", "row")


def build(docs: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Write the index of docs. It is written as a whole before it is read: the names of rows hold for the written table."""
    postings(docs, buckets).write.option("compression", "zstd").parquet(path)


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term, times. items: item_id, text."""
    posted = items.select("item_id", "text").withColumnsRenamed({"item_id": "doc_id"}).withColumn("row", F.lit(0)).mapInArrow(_posted, f"term string, row int, doc_id {items.schema['item_id'].dataType.simpleString()}, tf int, n int, head boolean")
    return posted.groupBy(F.col("doc_id").alias("item_id"), "term").agg(F.sum("tf").alias("times"))


def search(spark: SparkSession, path: str, items: DataFrame, top: int = TOP, buckets: int = BUCKETS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """item_id, rank, doc_id, score: each item's best `top` documents of the index at path."""
    wanted = kept(item_terms(items))
    asked = kept(wanted.select("term").distinct().withColumn("bucket", bucket(F.col("term"), buckets)).withColumn("term_no", F.monotonically_increasing_id()))
    sent = F.broadcast if wanted.count() <= broadcast_rows else lambda df: df
    index = spark.read.parquet(path)
    touched = [r["bucket"] for r in asked.select("bucket").distinct().collect()]  # at most `buckets` numbers
    met = index.where(F.col("bucket").isin(touched)).join(sent(asked), ["bucket", "term"])
    documents, all_terms = index.where("head").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = met.groupBy("term_no").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(float(2 * documents + 2)) / (2 * F.col("df") + 1))).cast("long")
    weighed = df.select("term_no", weight.alias("w"))
    asking = kept(wanted.join(asked.select("term", "term_no"), "term").join(weighed, "term_no").select("term_no", "item_id", (F.col("times") * F.col("w")).alias("w")))
    # rows of one document meet in one partition before they are multiplied by the items, and stay there for the sums
    m = F.expr(f"{100 - B} + (({B}L * n * {documents}L) div {max(1, all_terms)}L)")
    share = F.expr("w * ((1000000000L * tf) div (1000L * tf + 8 * m))")
    dealt = met.select("row", "doc_id", "term_no", "tf", m.alias("m")).repartition("row")
    sums = dealt.join(sent(asking), "term_no").groupBy("item_id", "row", "doc_id").agg(F.sum(share).alias("score")).where("score > 0")
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    return sums.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def rank(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """search() over an index of docs that is written to the shared folder for it and removed afterwards."""
    spark = docs.sparkSession
    path = fresh_path(spark, "postings")
    build(docs.select("doc_id", "text"), path)
    found = kept(search(spark, path, items.select("item_id", "text"), top))
    discard(path)
    return found


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                  regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}') AS ts FROM documents),
p AS (SELECT r, doc_id, len(ts) AS n, unnest(ts) AS term FROM d),
tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM p GROUP BY r, doc_id, n, term),
tot AS (SELECT count(*) AS nd, sum(len(ts))::BIGINT AS l FROM d WHERE len(ts) > 0),
w AS (SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, tot GROUP BY term, nd),
i AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS term FROM benchmark),
s AS (SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * ({100 - B} + (({B} * n * nd) // l)))))::BIGINT AS score
      FROM i JOIN tf USING (term) JOIN w USING (term), tot GROUP BY item_id, r, doc_id),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k WHERE rank <= {TOP}
"""
