"""Keyword search: BM25 over rows of several sources, the best row of a document counting.

Rows are tokenised and scored where they are read; only statistics of the corpus (one row for each source)
are gathered and sent back. ``postings`` and ``search_postings`` do the same over a stored index for many
queries at once: a query touches only its terms' postings.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions.dates import DateRange
from quillspan.functions.text import contains, fold, phrases, tokens

#: Fixed values of the ranking function.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def occurrences(words: Column, phrase: list[str]) -> Column:
    """How often a phrase stands in an array of words."""
    if len(phrase) == 1:
        first = F.lit(phrase[0])
        return F.size(F.filter(words, lambda w: w == first))
    # in running text: a slice for each place would copy the array each time; looking ahead counts overlaps
    text = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    return F.regexp_count(text, F.lit(f" (?={' '.join(phrase)} )"))


def bm25(rows: DataFrame, query: str) -> DataFrame:
    """document_id and score (lower is better) of each row of (document_id, text) with every part of the query.

    Statistics are of all rows, null texts included; where ``rows`` has a column ``live``, only rows of which it is true
    are found. A query without words matches nothing.
    """
    parts = phrases(query)
    if not parts:
        return rows.select("document_id", F.lit(0.0).alias("score")).filter(F.lit(False))
    tf = [f"f{i}" for i in range(len(parts))]

    def counted(some: DataFrame) -> DataFrame:
        words = some.select("document_id", tokens(F.col("text")).alias("w"))
        return words.select("document_id", F.size("w").alias("len"), *[occurrences(F.col("w"), p).alias(c) for c, p in zip(tf, parts, strict=True)])

    stats = counted(rows).agg(F.count("*").alias("n"), F.sum("len").cast("double").alias("total"), *[F.count_if(F.col(c) > 0).alias(f"n_{c}") for c in tf])
    # what doesn't hold every word as a substring needn't be cut into words
    low = fold(F.col("text"))
    live = rows.filter("live") if "live" in rows.columns else rows
    likely = live.filter(reduce(Column.__and__, [F.contains(low, F.lit(w)) for w in sorted({w for p in parts for w in p})]))
    hits = counted(likely).filter(reduce(Column.__and__, [F.col(c) > 0 for c in tf])).crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for c in tf:
        idf = F.log((F.col("n") - F.col(f"n_{c}") + 0.5) / (F.col(f"n_{c}") + 0.5))
        idf = F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf)
        score = score - idf * F.col(c) * (K1 + 1) / (F.col(c) + K1 * (1 - B + B * F.col("len") / (F.col("total") / F.col("n"))))
    return hits.select("document_id", score.alias("score"))


def in_range(column: Column, dates: DateRange, end_inclusive: bool = False) -> Column:
    """Instants of [start, end); null is out where a bound is given."""
    out = F.lit(True)
    if dates.start is not None:
        out = out & (column >= F.lit(dates.start))
    if dates.end is not None:
        out = out & (column <= F.lit(dates.end) if end_inclusive else column < F.lit(dates.end))
    return out


def search(documents: DataFrame, sources: dict[str, DataFrame], query: str, targets: tuple[str, ...] | None = None, include_deleted: bool = False, dates: DateRange = DateRange(), meeting: str | None = None) -> DataFrame:
    """id, title, created_at, score of documents with a matching row in a target, best first, then newest.

    sources: (document_id, text) rows by name, or a stored ``TextIndex`` of them; scores of different sources are compared as they are.
    """
    unknown = set(targets or ()) - set(sources)
    if unknown:
        raise ValueError(f"unknown targets: {sorted(unknown)}")
    chosen = [sources[t] for t in sources if targets is None or t in targets]
    best = reduce(DataFrame.unionByName, [bm25(rows, query) if isinstance(rows, DataFrame) else rows.bm25(query) for rows in chosen]).groupBy("document_id").agg(F.min("score").alias("score"))
    docs = documents.filter(in_range(F.col("created_at"), dates))
    if not include_deleted:
        docs = docs.filter("deleted_at is null")
    if meeting is not None:
        docs = docs.filter(contains(F.col("title"), meeting) | contains(F.col("id"), meeting))
    return docs.join(best, docs["id"] == best["document_id"]).select("id", "title", "created_at", "score").orderBy(F.col("score").asc(), F.col("created_at").desc(), F.col("id").asc())


def keyword_total(results: DataFrame) -> DataFrame:
    return results.agg(F.count("*").alias("keyword_total"))


def corpus_stats(rows: DataFrame) -> DataFrame:
    """n_rows, n_tokens, avg_len of a source."""
    sized = rows.select(F.size(tokens(F.col("text"))).alias("len"))
    return sized.agg(F.count("*").alias("n_rows"), F.sum("len").alias("n_tokens"), F.round(F.sum("len").cast("double") / F.count("*"), 6).alias("avg_len"))


def _parts(rows: DataFrame) -> int:
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def postings(rows: DataFrame) -> DataFrame:
    """term, document_id, row_id, tf, len: the stored index. Sort by term when writing, so that scans skip.

    Rows are dealt to a stated number of tasks, which aren't joined to large ones, and counted there.
    """
    words = rows.select("document_id", "row_id", "text").repartition(_parts(rows), "row_id").select("document_id", "row_id", tokens(F.col("text")).alias("w")).select("document_id", "row_id", F.size("w").alias("len"), F.explode("w").alias("term"))
    return words.groupBy("term", "document_id", "row_id", "len").agg(F.count("*").alias("tf"))


def document_frequencies(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def search_postings(index: DataFrame, n_rows: int, avg_len: float, queries: DataFrame) -> DataFrame:
    """query_id, document_id, score for many queries (query_id, term rows) at once; all terms must stand in the row."""
    wanted = queries.distinct()
    need = wanted.groupBy("query_id").agg(F.count("*").alias("need"))
    found = index.join(wanted, "term")
    df = index.join(wanted.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log((F.lit(n_rows) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(avg_len)))
    rows = found.join(df, "term").groupBy("query_id", "document_id", "row_id").agg(F.sum(part).alias("s"), F.count("*").alias("have")).join(need, "query_id").filter("have = need")
    return rows.groupBy("query_id", "document_id").agg(F.min(-F.col("s")).alias("score"))


def index_drift(index: DataFrame, rows: DataFrame) -> DataFrame:
    """Postings that only the stored index has (stale) or only the rows have (missing), counted, repeats included."""
    fresh = postings(rows)
    key = fresh.columns
    sides = index.select(*key, F.lit(1).alias("n")).unionAll(fresh.select(*key, F.lit(-1).alias("n")))
    differ = sides.repartition(_parts(rows), "row_id").groupBy(*key).agg(F.sum("n").alias("n")).filter("n <> 0")
    return differ.groupBy(F.when(F.col("n") > 0, "stale").otherwise("missing").alias("kind")).agg(F.sum(F.abs("n")).alias("n"))
