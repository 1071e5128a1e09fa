"""Ranked lexical search by norm buckets.

A document is its vector of impacts, one whole number per query term it holds: the term's weight times
its saturated, length-normalised frequency. A query is its vector of term counts, a score the product
of both. Vectors are range-partitioned by length (norm), longest first, and searched bucket after
bucket. A bucket is skipped for a query if its longest vector cannot reach the query's tenth best score
(Cauchy-Schwarz). Inside, the query's heaviest coordinates are added up, and the bound of the others by
the norms of what is left of both vectors leaves few documents; those are scored exactly in integers.

Terms are runs of digits, ASCII letters (A-Z lower-cased) and all signs beyond ASCII, in whole texts.
Null and empty texts hold none: they are not counted, found, or answered. Rows that repeat, or share a
``doc_id``, are documents of their own; a null ``doc_id`` comes last among equal scores, then the
order of rows decides. Rows of queries that share an ``item_id`` are ranked each for itself. Other
columns are not read. Empty tables give no row.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import prepare, staged
from shelfwise.llm.tokens import gathered, ragged, sums

BLOCK_ENTRIES = 1 << 20  # query terms searched at once; they are sent to every task
FLAG_BITS = 22  # flags that tell which terms no query holds, whatever the number of queries
FIRST_ROWS = 4096  # documents of the first round; each next one takes GROWTH times as many
GROWTH = 4
STEP_ROWS = 1 << 14  # documents compared at once in a task
BUCKETS = 4  # norm buckets per doubling
PARTS = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
COUNTED = "doc_id long, n long, terms array<string>, counts array<long>"
VECTORS = "doc_id long, row long, norm double, bucket int, terms array<int>, impacts array<long>"
FOUND = "item long, doc_id long, row long, score long"


def _terms(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All terms of the texts in a row, and how many each text has."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    lists = pc.split_pattern(pc.replace_substring_regex(pc.ascii_lower(texts), PARTS, " "), " ")
    words = lists.flatten()
    filled = pc.greater(pc.binary_length(words), 0)
    counts = sums(filled.to_numpy(zero_copy_only=False).astype(np.int64), np.diff(lists.offsets.to_numpy()))
    return pc.dictionary_encode(words.filter(filled)), counts


def counted(docs: DataFrame, key: str, flags: np.ndarray | None = None) -> DataFrame:
    """``doc_id`` (of ``key``), the number ``n`` of terms of a text, its different ``terms`` and
    their ``counts``; with ``flags`` only of terms whose flag is set."""
    shared = docs.sparkSession.sparkContext.broadcast(None if flags is None else np.packbits(flags))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if shared.value is None else np.unpackbits(shared.value)
        for batch in gathered(batches):
            encoded, totals = _terms(batch.column(1))
            words = encoded.dictionary.to_pylist()
            good = np.ones(len(words), bool)
            if wanted is not None:
                good = wanted[np.fromiter(map(_slot, words), np.int64, len(words))].astype(bool)
            place = encoded.indices.to_numpy().astype(np.int64)
            doc = np.repeat(np.arange(len(totals)), totals)[good[place]]
            pairs, counts = np.unique(doc * len(words) + place[good[place]], return_counts=True)
            doc, place = np.divmod(pairs, max(len(words), 1))
            bounds = pa.array(np.searchsorted(doc, np.arange(len(totals) + 1)).astype(np.int32))
            terms = encoded.dictionary.take(pa.array(place)).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(totals), pa.ListArray.from_arrays(bounds, terms),
                 pa.ListArray.from_arrays(bounds, pa.array(counts.astype(np.int64)))],
                names=["doc_id", "n", "terms", "counts"],
            )

    return docs.select(F.col(key).cast("long").alias("doc_id"), "text").mapInArrow(run, COUNTED)


def _slot(word: str) -> int:
    return zlib.crc32(word.encode()) & ((1 << FLAG_BITS) - 1)


def impacts(counts: np.ndarray, weights: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """Weighted impacts of terms that stand ``counts`` times in documents of ``n`` terms."""
    normal = 100 - 75 + (75 * n * documents) // length
    return weights * ((1_000_000_000 * counts) // (1000 * counts + 8 * normal))


class Block:
    """Queries that are searched together: their terms numbered, with weights, and their counts."""

    def __init__(self, entries: pd.DataFrame) -> None:
        """``entries`` has a row per query and different term: ``item``, ``term``, ``count``, ``weight``."""
        entries = entries.sort_values(["item", "weight", "term"], ascending=[True, False, True])
        codes, self.words = pd.factorize(entries["term"])
        self.weights = np.zeros(len(self.words), np.int64)
        self.weights[codes] = entries["weight"]
        self.items, sizes = np.unique(entries["item"].to_numpy(), return_counts=True)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.terms, self.counts = codes.astype(np.int64), entries["count"].to_numpy(np.int64)
        self.norms = np.sqrt(np.add.reduceat(self.counts.astype(float) ** 2, self.starts)) if len(sizes) else np.zeros(0)
        self.least = np.ones(len(self.items), np.int64)  # the score a document needs to matter

    @functools.cached_property
    def numbers(self) -> dict[str, int]:
        return dict(zip(self.words, range(len(self.words)), strict=True))


def vectors(texts: DataFrame, block: Block, documents: int, length: int) -> DataFrame:
    """The impact vectors of ``counted`` documents over a block's terms, by descending norm."""
    shared = texts.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            lists = batch.column(3)
            words = pc.dictionary_encode(lists.flatten())
            known = [own.numbers.get(word, -1) for word in words.dictionary.to_pylist()]
            term = np.array(known, np.int64)[words.indices.to_numpy()]
            doc = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            good = term >= 0
            term, doc, count = term[good], doc[good], batch.column(4).flatten().to_numpy()[good]
            value = impacts(count, own.weights[term], batch.column(2).to_numpy()[doc], documents, length)
            positive = value > 0
            term, doc, value = term[positive], doc[positive], value[positive]
            norm = np.sqrt(np.bincount(doc, value.astype(float) ** 2, batch.num_rows))
            kept = np.flatnonzero(norm > 0)
            bounds = pa.array(np.append(np.searchsorted(doc, kept), len(doc)).astype(np.int32))
            take = pa.array(kept)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(norm[kept]),
                 pa.array(np.floor(-BUCKETS * np.log2(norm[kept])).astype(np.int32)),
                 pa.ListArray.from_arrays(bounds, pa.array(term.astype(np.int32))),
                 pa.ListArray.from_arrays(bounds, pa.array(value))],
                names=["doc_id", "row", "norm", "bucket", "terms", "impacts"],
            )

    found = texts.select("doc_id", "row", "n", "terms", "counts").mapInArrow(run, VECTORS)
    # Many documents may share a norm, so the row is part of the order.
    return found.repartitionByRange(F.desc("norm"), "row").sortWithinPartitions(F.desc("norm"), "row")


class _Best:
    """The best documents of each query of a block that a task has seen."""

    def __init__(self, block: Block, limit: int) -> None:
        self.block, self.limit, self.least = block, limit, block.least.copy()
        empty = (np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.held = [empty] * len(block.items)  # scores, null ids, ids, rows

    def search(self, ids: np.ndarray, null: np.ndarray, row: np.ndarray, norm: np.ndarray, term: np.ndarray, sizes: np.ndarray, value: np.ndarray) -> None:
        """Compare documents, by descending norm, with every query that they can still answer."""
        block = self.block
        doc = np.repeat(np.arange(len(norm)), sizes)
        order = np.argsort(term, kind="stable")
        listed_doc, listed_value = doc[order], value[order]
        lists = np.searchsorted(term[order], np.arange(len(block.words) + 1))
        for item in np.flatnonzero(block.norms * norm[0] >= self.least * (1 - 1e-9)).tolist():
            start, end, least = block.starts[item], block.ends[item], self.least[item] * (1 - 1e-9)
            # Norms descend: only the first documents are long enough.
            reach = int(np.searchsorted(-norm, -(least / block.norms[item]), side="right"))
            terms, counts = block.terms[start:end], block.counts[start:end]
            begins, spans = lists[terms], lists[terms + 1] - lists[terms]
            focus = -(-len(terms) // 2)  # the heaviest half of the coordinates
            place = ragged(np.arange(len(doc)), begins[:focus], spans[:focus])
            at, times = listed_doc[place], np.repeat(counts[:focus], spans[:focus])
            part = np.bincount(at, listed_value[place] * times.astype(float), len(norm))[:reach]
            covered = np.bincount(at, listed_value[place].astype(float) ** 2, len(norm))[:reach]
            rest = np.sqrt(np.maximum(norm[:reach] ** 2 * (1 + 1e-9) - covered, 0.0))
            left = np.sqrt(float((counts[focus:].astype(float) ** 2).sum()))
            able = np.zeros(len(norm), bool)
            able[:reach] = part + left * rest >= least
            if not able.any():
                continue
            place = ragged(np.arange(len(doc)), begins, spans)
            times = np.repeat(counts, spans)[able[listed_doc[place]]]
            place = place[able[listed_doc[place]]]
            exact = np.zeros(len(norm), np.int64)
            np.add.at(exact, listed_doc[place], listed_value[place] * times)
            good = np.flatnonzero(exact >= self.least[item])
            joined = tuple(map(np.concatenate, zip(self.held[item], (exact[good], null[good], ids[good], row[good]), strict=True)))
            best = np.lexsort((joined[3], joined[2], joined[1], -joined[0]))[: self.limit]
            self.held[item] = tuple(column[best] for column in joined)
            if len(best) == self.limit:
                self.least[item] = max(self.least[item], self.held[item][0][-1])

    def rows(self) -> pa.RecordBatch:
        item = np.repeat(self.block.items, [len(h[0]) for h in self.held])
        score, null, ids, row = (np.concatenate([h[i] for h in self.held]) for i in range(4))
        return pa.RecordBatch.from_arrays(
            [pa.array(item), pa.array(ids, mask=null), pa.array(row), pa.array(score)],
            names=["item", "doc_id", "row", "score"],
        )


def searched(rows: DataFrame, block: Block, limit: int) -> DataFrame:
    """The best documents of every query in each task's part of the vectors."""
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, held, size = _Best(shared.value, limit), [], 0

        def search() -> None:
            batch = pa.concat_batches(held)
            order = np.argsort(-batch.column(2).to_numpy(), kind="stable")
            batch = batch.take(pa.array(order))
            ids, terms, values = batch.column(0), batch.column(3), batch.column(4)
            best.search(
                pc.fill_null(ids, 0).to_numpy(), pc.is_null(ids).to_numpy(zero_copy_only=False),
                batch.column(1).to_numpy(), batch.column(2).to_numpy(), terms.flatten().to_numpy().astype(np.int64),
                np.diff(terms.offsets.to_numpy()), values.flatten().to_numpy(),
            )

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= STEP_ROWS:
                search()
                held, size = [], 0
        if size:
            search()
        yield best.rows()

    return rows.select("doc_id", "row", "norm", "terms", "impacts").mapInArrow(run, FOUND)


def _top(found: pd.DataFrame, limit: int) -> pd.DataFrame:
    found = found.assign(null=found["doc_id"].isna())
    found = found.sort_values(["item", "score", "null", "doc_id", "row"], ascending=[True, False, True, True, True])
    found = found.drop(columns="null").assign(rank=found.groupby("item").cumcount() + 1)
    return found[found["rank"] <= limit].reset_index(drop=True)


def _search_block(texts: DataFrame, block: Block, documents: int, length: int, limit: int) -> pd.DataFrame:
    """The ranked documents of a block's queries: at most ``limit`` rows a query."""
    rows = staged(vectors(texts, block, documents, length), "vectors")
    sizes = rows.groupBy("bucket").agg(F.count("*"), F.max("norm")).orderBy("bucket").collect()  # a few a doubling
    best = pd.DataFrame({"item": [], "doc_id": [], "row": [], "score": []}).astype({"doc_id": "Int64"})
    at, most = 0, FIRST_ROWS
    while at < len(sizes) and (block.norms * sizes[at][2] >= block.least * (1 - 1e-9)).any():
        first, taken = at, 0
        while at < len(sizes) and (at == first or taken + sizes[at][1] <= most):
            taken, at = taken + sizes[at][1], at + 1
        most *= GROWTH
        part = rows.where(F.col("bucket").between(sizes[first][0], sizes[at - 1][0]))
        found = staged(searched(part, block, limit), "found")
        # Only what each task's best leave of the best of all reaches the driver.
        ranked = found.selectExpr(
            "*", "row_number() over (partition by item order by score desc, doc_id asc nulls last, row) as place"
        ).where(F.col("place") <= limit).drop("place")
        rounds = ranked.select("item", F.col("doc_id").cast("string"), "row", "score").toPandas()
        rounds["doc_id"] = pd.array([None if d is None else int(d) for d in rounds["doc_id"]], "Int64")
        best = _top(pd.concat([best, rounds], ignore_index=True).drop(columns="rank", errors="ignore"), limit)
        full = best[best["rank"] == limit]
        block.least[np.searchsorted(block.items, full["item"].to_numpy(np.int64))] = full["score"].to_numpy(np.int64)
    return best


def ranked(docs: DataFrame, items: DataFrame, limit: int = 10, block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """``item_id``, ``rank`` (from 1), ``doc_id`` and ``score`` of the best documents of each item.

    The items are searched in blocks of about ``block_entries`` terms, whatever their number.
    """
    spark = prepare(docs.sparkSession)
    queries = staged(items.select("item_id", "text").withColumn("item", F.monotonically_increasing_id()), "items")
    asked = counted(queries, "item").select(F.col("doc_id").alias("item"), F.explode(F.arrays_zip("terms", "counts")).alias("e"))
    asked = staged(asked.select("item", F.col("e.terms").alias("term"), F.col("e.counts").alias("count")), "asked")
    slot = F.crc32(F.col("term").cast("binary")).bitwiseAND(F.lit((1 << FLAG_BITS) - 1))
    flags = np.zeros(1 << FLAG_BITS, bool)
    flags[asked.select(slot.cast("int").alias("slot")).distinct().toPandas()["slot"].to_numpy(np.int64)] = True
    texts = staged(counted(docs, "doc_id", flags).withColumn("row", F.monotonically_increasing_id()), "counted")
    documents, length = texts.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    holding = texts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(documents) + 2) / (2 * F.col("df") + 1)))
    entries = staged(
        asked.join(holding, "term").select("item", "term", "count", weight.cast("long").alias("weight")), "entries"
    )
    blocks = -(-entries.count() // block_entries)
    answers = []
    for number in range(blocks):
        part = entries.where(F.pmod(F.xxhash64(F.lit("block"), "item"), F.lit(blocks)) == number).toPandas()
        if len(part):
            best = _search_block(texts, Block(part), documents, length, limit)
            columns = ("item", "doc_id", "rank", "score")
            rows = [tuple(None if pd.isna(v) else int(v) for v in r) for r in best[list(columns)].itertuples(index=False)]
            answers.append(staged(spark.createDataFrame(rows, "item long, doc_id long, rank int, score long"), "answers"))
    if not answers:
        return queries.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    answer = functools.reduce(DataFrame.unionByName, answers)
    return answer.join(queries.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
