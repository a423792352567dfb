"""Secret scans with multipart credential linking, in Spark expressions only.

Strong kinds (key assignments, access identifiers, hexadecimal keys) are
reported wherever they stand.  Weak parts (long mixed-case words that may be
secrets, user assignments that may be identifiers, host names that may be
endpoints) are common in clean text and reported only with company: a weak
secret counts when an identifier or an assignment and an endpoint, or an
access identifier, stand in its scope, and the parts found with it are
reported too.  Scopes are intervals around the weak secret; they are joined
by the cells of a grid of their width, so the join has an equality and a cell
holds few parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, columns_of, let, without

#: The base kinds.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Weak parts: a secret is 32 or more characters of the base64 alphabet (digits and both cases are asked for besides), a user is an assignment, an endpoint a URL with a host or a host with a port.
WEAK_SECRET = r"[A-Za-z0-9+/_=-]{32,}"
WEAK_USER = r"""(?:[Uu][Ss][Ee][Rr](?:[Nn][Aa][Mm][Ee])?|[Ll][Oo][Gg][Ii][Nn]|[Cc][Ll][Ii][Ee][Nn][Tt]_?[Ii][Dd])["']?\x20*[:=]\x20*["']?[A-Za-z0-9@+/_.=-]+"""
ENDPOINT = r"[a-z][a-z0-9+]{1,10}://[A-Za-z0-9.-]+\.[A-Za-z0-9.-]+(?::[0-9]+)?|[a-z0-9-]+(?:\.[a-z0-9-]+)+:[0-9]{2,5}"
#: ENDPOINT as it is searched for: the same matches, in time that grows with the text.  A host is tried only where no longer one can
#: begin: not inside a label or after a label's dot, but for those that the match before it ends in.  Nothing is given back, as what
#: follows a label is none of its characters.
_ENDPOINT = ENDPOINT.replace("|[a-z0-9-]+(?:\\.[a-z0-9-]+)+:", r"|(?:(?<![a-z0-9-])(?<![a-z0-9-]\.)|\G|(?<=\G\.))[a-z0-9-]++(?:\.[a-z0-9-]++)++:")
#: Scope: characters between a weak secret and a part that it is linked with.
SCOPE = 200

#: Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "secret", "user", "endpoint")


#: Items in a block of a running sum or maximum.
_BLOCK = 64


def _none() -> Column:
    """No spans."""
    return F.array().cast("array<struct<start:int,kind:int,stop:int>>")


def _running(values: Column, op, zero: int, levels: int = 2) -> Column:
    """What ``op`` makes of all items before each one of an array that has items.

    An aggregate that keeps an array copies it at each item, so only single
    numbers are carried on: over the items of a block, and over the blocks.
    """
    all_of = lambda xs: F.aggregate(xs, F.lit(zero), op)
    before = lambda xs: F.transform(xs, lambda _, j: all_of(F.slice(xs, F.lit(1), j)))
    if not levels:
        return let(values, before)

    def blocked(xs: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / _BLOCK).cast("int")), lambda k: F.slice(xs, k * _BLOCK + 1, _BLOCK))
        ahead = lambda blocks: _running(F.transform(blocks, all_of), op, zero, levels - 1)
        return let(cut, lambda blocks: F.flatten(F.zip_with(blocks, ahead(blocks), lambda x, at: F.transform(before(x), lambda v: op(at, v)))))

    return let(values, blocked)


def _spans(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """array<struct<start, kind, stop>> of the leftmost non-overlapping matches, in code points; ``keep`` filters by the matched string."""
    # the text after the last match is a pair without a match
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("b"))
    size = lambda said: F.coalesce(F.char_length(said), F.lit(0))

    def placed(pairs: Column) -> Column:
        at = _running(F.transform(pairs, lambda p: size(p["b"]) + size(p["m"])), lambda a, v: a + v, 0)
        all_ = F.zip_with(pairs, at, lambda p, a: F.struct((a + size(p["b"])).alias("start"), (a + size(p["b"]) + size(p["m"])).alias("stop"), p["m"].alias("m")))
        found = F.filter(all_, lambda s: s["m"].isNotNull() & keep(s["m"]) if keep else s["m"].isNotNull())
        return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["stop"].alias("stop")))

    return F.when(text.rlike(pattern), let(pairs, placed)).otherwise(_none())


def _listed(spans: Column) -> Column:
    """kind:start:stop by start, then kind, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def find_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(doc_id, base, linked) for each row of ``docs`` (doc_id, text): arrays of (start, kind, stop), stop exclusive, in code points.

    base are the strong matches, linked the weak parts that complete each
    other.  Null and empty texts have none; a null doc_id is kept; repeated
    rows each get their own; an empty table gives none; other columns are not
    read.  Time grows with the text, whatever it holds.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    mixed = lambda m: m.rlike("[0-9]") & m.rlike("[A-Z]") & m.rlike("[a-z]")
    found = checkpointed(
        docs.select(
            "doc_id",
            _tag(text).alias("tag"),
            F.concat(
                _spans(text, ASSIGN, 0, lambda m: F.char_length(F.regexp_extract(m, ASSIGN, 2)) >= 6),
                _spans(text, ACCESS, 1),
                _spans(text, HEX, 2),
            ).alias("base"),
            # company is looked for only where there is something to complete
            F.when(text.rlike(WEAK_SECRET), F.concat(_spans(text, WEAK_SECRET, 3, mixed), _spans(text, WEAK_USER, 4), _spans(text, _ENDPOINT, 5))).otherwise(_none()).alias("weak"),
        )
    )
    key = F.struct("doc_id", "tag")
    # only rows with a weak secret can link; rows that repeat doc_id and text are alike and linked once
    rows = found.where(F.exists("weak", lambda s: s["kind"] == 3)).select(key.alias("key"), "base", "weak").dropDuplicates(["key"])
    secrets = rows.select("key", F.explode(F.filter("weak", lambda s: s["kind"] == 3)).alias("s"))
    # a part before the secret ends in the scope, one after it begins there: each lies in the cells of its ends
    cells = lambda start, stop: F.sequence(F.floor(start / scope), F.floor(stop / scope))
    scopes = F.array_union(cells(F.col("s.start") - scope, F.col("s.start") - 1), cells(F.col("s.stop"), F.col("s.stop") + scope - 1))
    secrets = secrets.select("key", "s", F.explode(scopes).alias("cell"))
    parts = rows.select("key", F.explode(F.concat(F.filter("base", lambda s: s["kind"] < 2), F.filter("weak", lambda s: s["kind"] > 3))).alias("p"))
    parts = parts.select("key", "p", F.explode(F.array_distinct(F.array(F.floor(F.col("p.start") / scope), F.floor((F.col("p.stop") - 1) / scope)))).alias("cell"))
    near = (F.col("p.start") < F.col("s.stop") + scope) & (F.col("p.stop") > F.col("s.start") - scope) & ((F.col("p.stop") <= F.col("s.start")) | (F.col("p.start") >= F.col("s.stop")))
    has = lambda k: F.max(F.when(F.col("p.kind") == k, 1).otherwise(0))
    linked = secrets.join(parts, ["key", "cell"]).where(near)
    complete = linked.groupBy("key", "s").agg(has(0).alias("a"), has(1).alias("i"), has(4).alias("u"), has(5).alias("e"), F.collect_set("p").alias("ps")).where("i = 1 OR (e = 1 AND (a = 1 OR u = 1))")
    linked = complete.select("key", F.explode(F.concat(F.array("s"), F.filter("ps", lambda s: s["kind"] > 3))).alias("span"))
    spans = linked.groupBy("key").agg(F.collect_set("span").alias("linked"))
    spans = spans.select(F.col("key.doc_id").alias("_doc"), F.col("key.tag").alias("_tag"), "linked")
    return found.join(spans, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("tag") == F.col("_tag")), "left").select(
        "doc_id", F.array_sort("base").alias("base"), F.coalesce("linked", _none()).alias("linked"), "tag"
    )


def digests(found: DataFrame) -> DataFrame:
    """``find_secrets`` in counts, the digest of the base spans, and all spans listed."""
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), _listed(F.concat("base", "linked")).alias("spans"))


def _tag(text: Column) -> Column:
    """128 bits that tell a text from others."""
    return F.struct(F.xxhash64(text).alias("one"), F.xxhash64(F.lit(1), text).alias("two"))


def _covered(spans: Column) -> Column:
    """Disjoint (start, stop) intervals, ascending, that cover ``spans``; there is one at least."""

    def covered(spans: Column) -> Column:
        stops = F.transform(spans, lambda s: s["stop"])
        known = F.zip_with(spans, _running(stops, lambda a, v: F.greatest(a, v), -1), lambda s, before: F.struct(s["start"].alias("start"), before.alias("before")))
        # an interval begins where no span before it reaches, and ends where the spans before the next one do
        begins = F.filter(known, lambda k: k["start"] > k["before"])
        ends = lambda b: F.concat(F.transform(F.slice(b, F.lit(2), F.size(b)), lambda k: k["before"]), F.array(F.array_max(stops)))
        return let(begins, lambda b: F.zip_with(b, ends(b), lambda k, stop: F.struct(k["start"].alias("start"), stop.alias("stop"))))

    return let(F.array_sort(spans), covered)


def redact(docs: DataFrame, mask: str = "[SECRET]", scope: int = SCOPE) -> DataFrame:
    """``docs`` with every found span in ``text`` replaced by ``mask``; spans that meet become one.

    Null texts stay null and empty ones empty; a null doc_id is kept; repeated
    rows are masked alike; an empty table gives none; other columns pass
    through under any name.
    """
    spans = find_secrets(docs, scope).select("doc_id", "tag", F.concat("base", "linked").alias("spans")).where(F.size("spans") > 0)
    spans = spans.dropDuplicates(["doc_id", "tag"]).select("doc_id", "tag", _covered(F.col("spans")).alias("cut")).alias("found")
    tag = _tag(F.coalesce(F.col("own.text"), F.lit("")))
    joined = docs.alias("own").join(spans, F.col("own.doc_id").eqNullSafe(F.col("found.doc_id")) & (tag == F.col("found.tag")), "left")
    text = F.when(F.col("found.cut").isNull() | F.col("own.text").isNull(), F.col("own.text")).otherwise(without(F.col("own.text"), F.col("found.cut"), mask))
    return joined.select(*columns_of(docs, "own", text=text))


def _oracle() -> str:
    patterns = ", ".join(f"({k}, '{p.replace(chr(39), chr(39) * 2)}')" for k, p in enumerate((ASSIGN, ACCESS, HEX, WEAK_SECRET, WEAK_USER, ENDPOINT)))
    group = f"length(regexp_extract(m, '{ASSIGN.replace(chr(39), chr(39) * 2)}', 2)) >= 6"
    name = "CASE kind " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(KINDS)) + " END"
    return f"""
WITH k(kind, pat) AS (VALUES {patterns}),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS (SELECT doc_id, kind, regexp_extract_all(text, pat) AS ms, string_split_regex(text, pat) AS bs FROM d, k WHERE regexp_matches(text, pat)),
u AS (SELECT doc_id, kind, unnest(ms) AS m, unnest(bs[1:len(ms)]) AS b, unnest(range(len(ms))) AS i FROM m),
p AS (SELECT doc_id, kind, m, CAST(sum(length(b) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS BIGINT) AS stop FROM u),
s AS (SELECT doc_id, kind, stop - length(m) AS start, stop FROM p
  WHERE CASE WHEN kind = 0 THEN {group} WHEN kind = 3 THEN regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]') ELSE TRUE END),
l AS (SELECT a.doc_id, a.start AS s_start, a.stop AS s_stop, b.kind, b.start, b.stop FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.kind = 3 AND b.kind IN (0, 1, 4, 5)
  AND b.start < a.stop + {SCOPE} AND b.stop > a.start - {SCOPE} AND (b.stop <= a.start OR b.start >= a.stop)),
c AS (SELECT doc_id, s_start, s_stop FROM l GROUP BY ALL HAVING bool_or(kind = 1) OR (bool_or(kind = 5) AND (bool_or(kind = 0) OR bool_or(kind = 4)))),
x AS (SELECT doc_id, kind, start, stop FROM s WHERE kind < 3
  UNION SELECT doc_id, 3, s_start, s_stop FROM c
  UNION SELECT doc_id, kind, start, stop FROM l JOIN c USING (doc_id, s_start, s_stop) WHERE kind > 3),
t AS (SELECT *, {name} || ':' || start || ':' || stop AS said FROM x),
a AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  string_agg(said, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(said, ',' ORDER BY start, kind) AS spans FROM t GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (doc_id)"""


ORACLE = _oracle()
