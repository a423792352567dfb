"""Source divergence audit: which sources of a language use its terms differently, and which terms tell them apart.

Terms that occur equally often in every source are alike to the audit.  So
they are grouped by their sparse vector of counts per source; every pair of
sources is worked out once for each distinct vector and counts as often as
terms have it.  The terms that mark a source are ranked by name.

All shares and divergences are integers, and exact.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, forget, released, with_package

#: Documents of its language that a term is in, at least; terms reported per source; unit of the shares.
LEAST_DOCS, MOST_TERMS, UNIT = 10, 10, 1_000_000_000
#: Distinct (source, term) pairs that a task adds up at a time.
HELD_TERMS = 400_000
#: Cells of a dense block of vectors.
CELLS = 1 << 20
_DOC = 1 << 40  # a count holds occurrences below this and documents above it, until it is emitted
# lower-case letters and bytes beyond ASCII stay, upper-case letters become lower-case, all else ends a term
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and characters beyond ASCII, with A-Z as a-z."""
    return text.translate(_FOLD).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) by task: occurrences and documents; a null term stands for the group itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str], dict[bytes, int]] = {}
        held = 0

        def counted() -> Iterator[pa.RecordBatch]:
            for (lang, source), found in seen.items():
                said = pa.array([*found, None], pa.binary()).cast(pa.string())
                both = np.fromiter((*found.values(), 0), np.int64, len(said))
                size = len(said)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()), said, pa.array(both & (_DOC - 1)), pa.array(both >> 40)], names=["lang", "source", "term", "n", "docs"]
                )
            seen.clear()

        for batch in batches:
            for lang, source, text in zip(*batch.columns, strict=True):
                found = seen.setdefault((lang.as_py(), source.as_py()), {})
                before = len(found)
                get = found.get
                for term, n in Counter(terms(text.as_py())).items():
                    found[term] = get(term, 0) + n + _DOC
                held += len(found) - before
                if held >= HELD_TERMS:
                    yield from counted()
                    held = 0
        yield from counted()
        released()

    said = lambda c: F.coalesce(c, F.lit(""))
    rows = with_package(docs).select(said("lang").alias("lang"), said("source").alias("source"), said("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def count_vectors(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, vector) of every kept term: its sources, ascending, with its count in each; a null term has all sources of the language."""
    table = term_counts(docs).repartition("lang", "term")  # all that follows keeps this partitioning
    sums = table.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    vectors = sums.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("vector"))
    return vectors.where((F.col("docs") >= least_docs) | F.col("term").isNull()).select("lang", "term", "vector")


def _share(n: str, total: str, size: str) -> Column:
    return F.expr(f"1 + (CAST({n} + 2 AS DECIMAL(20, 0)) * {UNIT} div ({total} + 2 * {size}))")


def exact_shares(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (n + 2) / total), by long division with decimal digits: no product passes 64 bits up to totals of 9 * 10**17."""
    whole, rest = np.divmod(n + 2, total)
    for _ in range(9):
        more, rest = np.divmod(rest * 10, total)
        whole = whole * 10 + more
    return 1 + whole


def _pair_sums(vectors: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value): the divergence of each pair of sources, a < b, over all terms of ``vectors`` (lang, vector, m)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang in pc.unique(batch.column("lang")):
                rows = batch.filter(pc.equal(batch.column("lang"), lang))
                group = rows.column("groups")[0]
                names, size = group["sources"].values, group["terms"].as_py()
                totals = group["totals"].values.to_numpy() + 2 * size
                m = rows.column("m").to_numpy()
                vector = rows.column("vector")
                cells = vector.flatten()
                place = pc.index_in(cells.field("source"), value_set=names).to_numpy()
                n, row = cells.field("n").to_numpy(), np.repeat(np.arange(len(m)), pc.list_value_length(vector).to_numpy())
                k = len(names)
                sums = np.zeros((k, k), np.int64)
                step = max(1, CELLS // k)
                for at in range(0, len(m), step):
                    some = (row >= at) & (row < at + step)
                    share = np.tile(exact_shares(np.zeros(k, np.int64), totals), (min(step, len(m) - at), 1))
                    share[row[some] - at, place[some]] = exact_shares(n[some], totals[place[some]])
                    weight = m[at : at + step]
                    for i in range(k - 1):
                        apart = share[:, i + 1 :] - share[:, i : i + 1]
                        sums[i, i + 1 :] += weight @ (apart * apart // (share[:, i + 1 :] + share[:, i : i + 1]))
                one, two = np.triu_indices(k, 1)
                for at in range(0, len(one), 1 << 16):
                    i, j = one[at : at + (1 << 16)], two[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array([lang.as_py()] * len(i), pa.string()), names.take(pa.array(i)), names.take(pa.array(j)), pa.array(sums[i, j])], names=["lang", "a", "b", "value"])
        released()

    rows = _keyed_join(vectors, groups.select("lang", F.struct("sources", "totals", "terms").alias("groups")), "lang")
    return with_package(rows).mapInArrow(run, "lang string, a string, b string, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def _keyed_join(rows: DataFrame, table: DataFrame, *on: str) -> DataFrame:
    """Inner join by a key that neither side is partitioned by, so that adaptive execution can split a value of very many rows, unless it broadcasts a small table."""
    key = F.bitwise_not(F.xxhash64(*on)).alias("_key")
    return rows.select("*", key).join(table.select("*", key), ["_key", *on]).drop("_key")


def divergence_audit(docs: DataFrame, least_docs: int = LEAST_DOCS, most_terms: int = MOST_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source of a language lies from each other one, and its own marked terms.

    The terms of a language are those in ``least_docs`` of its documents.
    Part pair has all other sources, by the sum of divergences; part term the
    ``most_terms`` terms that the source uses and uses more than its language,
    by their divergence from it.  Ties go by item, in byte order.

    Null texts, languages and sources are empty ones, and empty ones are
    groups like any other; sources without a kept term have pairs and no
    terms; repeated rows are documents of their own, whatever their doc_id;
    very long texts are taken whole; an empty table gives none; other columns
    are not read.
    """
    kept = checkpointed(count_vectors(docs, least_docs))
    named = kept.where("term IS NOT NULL")
    distinct = checkpointed(named.groupBy("lang", "vector").agg(F.count("*").alias("m")))
    totals = distinct.select("lang", "m", F.inline("vector")).groupBy("lang", "source").agg(F.sum(F.col("m") * F.col("n")).alias("total"))
    sizes = distinct.groupBy("lang").agg(F.sum("m").alias("terms"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    every = kept.where("term IS NULL").select("lang", F.inline("vector")).select("lang", "source")
    groups = checkpointed(every.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").select("lang", "source", zero("total"), zero("terms")))
    by_lang = groups.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "total"))).alias("all"), F.first("terms").alias("terms"), F.sum("total").alias("whole"))
    langs = by_lang.select("lang", F.col("all.source").alias("sources"), F.col("all.total").alias("totals"), "terms", "whole")

    sums = checkpointed(_pair_sums(distinct, langs))
    forget(distinct)
    others = langs.select("lang", "sources", F.explode("sources").alias("source")).select("lang", "source", F.explode("sources").alias("item")).where("source <> item")
    both = others.select("*", F.least("source", "item").alias("a"), F.greatest("source", "item").alias("b")).join(sums, ["lang", "a", "b"], "left")
    order = [F.desc("value"), F.asc("item")]
    group = Window.partitionBy("lang", "source").orderBy(*order)
    pairs = both.select("lang", "source", F.lit("pair").alias("part"), "item", zero("value")).withColumn("rank", F.row_number().over(group))

    whole = F.aggregate("vector", F.lit(0).cast("long"), lambda n, c: n + c["n"]).alias("said")
    used = named.select("lang", "term", whole, F.inline("vector"))
    stats = groups.join(langs.select("lang", "whole"), "lang")
    shares = _keyed_join(used, stats, "lang", "source").select("lang", "source", "term", _share("n", "total", "terms").alias("p"), _share("said", "whole", "terms").alias("q"))
    marked = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
    # a group's best are among the best of each of its parts
    part = marked.withColumn("slice", F.pmod(F.xxhash64("item"), F.lit(64)))
    part = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "slice").orderBy(*order))).where(F.col("rank") <= most_terms)
    best = part.withColumn("rank", F.row_number().over(group)).where(F.col("rank") <= most_terms)
    return pairs.unionByName(best.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))


#: The same audit in DuckDB SQL, with every pair of sources worked out for every term.
ORACLE = r"""
WITH docs AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
said AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS c FROM said GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS c FROM said JOIN kept USING (lang, term) GROUP BY ALL),
cells AS (SELECT g.lang, g.source, k.term, coalesce(n.c, 0) AS c, k.c AS whole FROM groups g JOIN kept k ON k.lang = g.lang LEFT JOIN counts n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
shares AS (SELECT lang, source, term, c,
  1 + CAST(CAST(c + 2 AS HUGEINT) * 1000000000 // (sum(c) OVER g + 2 * count(*) OVER g) AS BIGINT) AS p,
  1 + CAST(CAST(whole + 2 AS HUGEINT) * 1000000000 // (sum(whole) OVER g + 2 * count(*) OVER g) AS BIGINT) AS q
  FROM cells WINDOW g AS (PARTITION BY lang, source)),
sums AS (SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS BIGINT) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
marked AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM shares WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM marked))
WHERE part = 'pair' OR rank <= 10
"""
