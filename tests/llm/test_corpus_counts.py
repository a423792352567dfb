"""Collocations, mixing and the divergence audit against brute-force versions, with their edge cases."""

from __future__ import annotations

import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("gridloom.llm.queries")
from gridloom.llm import collocations, divergence, mixing  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["n long", "rank string", "home int", "size string", "taken int", "copies string", "vector int", "term int", "own int", "m string", "slot int", "_two int"]


def prose(rng, n, words):
    return "".join(rng.choice(words) + rng.choice([" ", " ", " ", " ", "  ", "\t", ", ", ".\n", "! "]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    common = ["the", "The", "of", "a", "é", "É", "naïve", "漢字", "x1", "it's", "und", " y", "z\x00z", "Ab-cD"]
    out = []
    for i in range(260):
        lang, source = rng.choice(["en", "en", "de", None]), rng.choice(["a", "a", "a", "b", "c", None, "Z", "é"])
        out.append((i, prose(rng, rng.randint(0, 60), common + [f"w{i % 7}"]), lang, source, 0))
    phrase = "over the lazy dog again"
    out += [(1000 + i, f"{phrase} and {phrase}", "en", "hot", 1) for i in range(60)]  # one group of copies
    out += [(7, "the the the the the", "en", "a", None)] * 40  # repeated rows of one doc_id
    out += [(2000, None, None, None, None), (None, "no id", "fr", "lone", None), (2001, "", "it", "", None), (2002, " \n\t ", "it", "b", None), (2003, "of a " * 40_000, "en", "b", None), (2004, "1 2 3 4 5", "xx", "q", 0), (2005, "6 7", "xx", "r", 0)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.select("*", *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in CLASH]).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def ascii_lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t)


def brute_collocations(rows, least=30, longest=4, most=2000):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", ascii_lower(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, count in f.items():
        known = {p: c for p, c in count.items() if c >= least}
        inside = Counter()
        for p, c in known.items():
            for i, j in itertools.combinations(range(len(p) + 1), 2):
                if j - i < len(p):
                    inside[p[i:j]] = max(inside[p[i:j]], c)
        found = []
        for p, a in known.items():
            if len(p) > 1 and 100 * inside[p] < 80 * a:
                score, k = min((2000000 * a // (count[p[:k]] + count[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), p, k))
        for rank, (score, a, said, p, k) in enumerate(sorted(found)[:most], 1):
            out.append((lang, rank, said.decode(), -a, count[p[:k]], count[p[k:]], n[lang], -score))
    return sorted(out)


def test_collocations_by_brute_force(spark, docs, rows, empty):
    got = collocations.collocations(docs)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute_collocations(rows)
    assert sorted(map(tuple, collocations.collocations(docs, least=3, most=25).collect())) == brute_collocations(rows, 3, most=25)
    assert collocations.collocations(empty).collect() == []


def test_collocations_do_not_depend_on_bounds(docs, rows, monkeypatch):
    """A table of few words, a filter of few bits, blocks of few bytes and pivots dealt to many partitions give the same phrases."""
    monkeypatch.setattr(collocations, "SHARE", 7)
    known = lambda **k: sorted(map(tuple, collocations.frequent_phrases(docs, 5, **k)[0].collect()))
    whole = known()
    brute = Counter()
    for _, text, lang, *_ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", ascii_lower(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            brute.update(("und" if lang is None else lang, " ".join(words[i : i + k]), k) for k in range(1, 5) for i in range(len(words) - k + 1))
    assert whole == sorted((*p, c) for p, c in brute.items() if c >= 5)
    assert known(table=4, bits=64) == whole == known(table=0, bits=1 << 10)


def test_fragments_give_each_phrase_to_one_pivot():
    """Every phrase of a text comes out of exactly one fragment."""
    rng = np.random.default_rng(3)
    for _ in range(50):
        word = rng.integers(0, 6, 80)
        order = np.concatenate([[-1], rng.permutation(5)])
        order[rng.integers(1, 6)] = -1
        got = Counter()
        for members, n in zip(*collocations.fragment_block(word, order, 4), strict=True):
            here = np.flatnonzero(members)
            i, j = 3 - here.min(), here.max() - 3
            for a, b in itertools.product(range(i + 1), range(j + 1)):
                if 1 <= a + b <= 3:
                    got[tuple(members[3 - a : 4 + b])] += int(n)
        want = Counter()
        for k in (2, 3, 4):
            for at in range(len(word) - k + 1):
                p = word[at : at + k]
                if (order[p] >= 0).all():
                    want[tuple(p)] += 1
        assert got == want


def shares(sizes):
    """Targets by the letter: the excess of sources that stop is shared again by weight."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    held, total = {}, sum(sizes.values())
    while True:
        rest = [s for s in order if s not in held]
        left = total - sum(held.values())
        part = {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        over = [s for s in rest if part[s] > 3 * sizes[s]]
        if not over:
            return held | part
        held |= {s: 3 * sizes[s] for s in over}


def check_mix(got, rows):
    sizes, taken, target = Counter(), Counter(), {}
    longest = Counter()
    want = Counter((i, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, *_ in rows)
    assert Counter((r.doc_id, r.size) for r in got) == want
    for r in got:
        assert r.taken % max(1, r.size) == 0 and 0 <= r.taken <= 3 * r.size and r.copies == (r.taken // r.size if r.size else r.copies)
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        longest[r.source] = max(longest[r.source], r.size)
    assert all(r.source_size == sizes[r.source] for r in got)
    assert target == pytest.approx(shares(sizes))
    return {s: taken[s] - target[s] for s in target}


def test_mix_reaches_its_targets(spark, docs, rows, empty):
    got = mixing.mix(docs).collect()
    gaps = check_mix(got, rows)
    assert sum(abs(g) <= 1 for g in gaps.values()) >= len(gaps) - 2  # sources of one or two documents cannot be met
    again = mixing.mix(docs.repartition(7)).collect()
    key = lambda rs: sorted((str(r.doc_id), r.size, str(r.source), r.target, r.taken) for r in rs)
    assert key(got) == key(again)
    assert mixing.mix(empty).collect() == []


def test_mix_of_many_rows_that_are_alike(spark):
    """Groups beyond the rows that are ranked at a time, with one row that a third of all are."""
    rows = [(5, "one two", "en", "a", 0)] * 900 + [(i, "x " * (1 + i % 3), "en", "ab"[i % 2], 0) for i in range(1800)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = mixing.mix(df, ranked=16).collect()
    assert all(abs(g) <= 1 for g in check_mix(got, rows).values())
    plain = mixing.mix(df).collect()
    assert Counter((r.doc_id, r.taken) for r in got) == Counter((r.doc_id, r.taken) for r in plain)


def test_first_k_by_ranking(spark):
    rng = random.Random(4)
    rows = [(g, {1: 0, 2: 5, 3: 333, 4: 1000}[g], n, rng.getrandbits(63) * rng.choice([1, -1]) if g != 3 else 77, rng.getrandbits(63)) for g, n in ((1, 50), (2, 40), (3, 1000), (4, 1000)) for _ in range(n)]
    df = spark.createDataFrame(rows, "g long, k long, n long, one long, two long")
    got = mixing.first_k(df, "g", "n", "k", ["one", "two"], ranked=8).collect()
    want = {r for g in range(1, 5) for r in sorted((r for r in rows if r[0] == g), key=lambda r: r[3:])[: {1: 0, 2: 5, 3: 333, 4: 1000}[g]]}
    assert {tuple(r)[:5] for r in got if r._in} == want and len(got) == len(rows)


@pytest.mark.parametrize("seed", range(6))
def test_budgets_are_met_as_near_as_can_be(seed):
    rng = np.random.default_rng(seed)
    size = rng.choice(np.arange(2, 40), 5, replace=False).astype(np.int64)
    count = rng.integers(0, 6, 5).astype(np.int64)
    sums = {sum(int(a * s) for a, s in zip(pick, size, strict=True)) for pick in itertools.product(*[range(c + 1) for c in count])}
    for budget in range(0, int((size * count).sum()) + 1, 7):
        k = mixing.fitted(size, count, budget, exact=1 << 30)
        assert (k >= 0).all() and (k <= count).all()
        assert abs(int((k * size).sum()) - budget) == min(abs(s - budget) for s in sums)
        k = mixing.fitted(size, count, budget, exact=20)
        assert (k >= 0).all() and (k <= count).all() and abs(int((k * size).sum()) - budget) <= size.max()


def test_budget_of_many_lengths_is_exact():
    rng = np.random.default_rng(1)
    size = np.unique(rng.integers(1, 20_000, 4000))
    count = rng.integers(1, 9, len(size))
    for share in (0.013, 0.4, 0.98):
        budget = int((size * count).sum() * share)
        k = mixing.fitted(size, count, budget)
        assert (k >= 0).all() and (k <= count).all() and int((k * size).sum()) == budget
        assert abs((k / count).mean() - share) < 0.15  # all lengths take part


def brute_audit(rows, least=10):
    groups, docs_with, total, seen = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        words = Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", ascii_lower(text or "")))
        groups[lang, source].update(words)
        docs_with[lang].update(words.keys())
        total[lang].update(words)
    out = []
    for lang, source in groups:
        kept = [t for t, n in docs_with[lang].items() if n >= least]
        share = lambda c: {t: 1 + 1000000000 * (c[t] + 2) // (sum(c[k] for k in kept) + 2 * len(kept)) for t in kept}
        p, q = share(groups[lang, source]), share(total[lang])
        f = lambda a, b: (a - b) ** 2 // (a + b)
        pairs = []
        for lang2, other in groups:
            if lang2 == lang and other != source:
                r = share(groups[lang, other])
                pairs.append((-sum(f(p[t], r[t]) for t in kept), other.encode()))
        terms = [(-f(p[t], q[t]), t.encode()) for t in kept if groups[lang, source][t] and p[t] > q[t]]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:10])):
            out += [(lang, source, part, item.decode(), -v, rank) for rank, (v, item) in enumerate(found, 1)]
    return sorted(out)


def test_audit_by_brute_force(docs, rows, empty):
    got = divergence.divergence_audit(docs)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute_audit(rows)
    assert sorted(map(tuple, divergence.divergence_audit(docs, 1).collect())) == brute_audit(rows, 1)
    assert divergence.divergence_audit(empty).collect() == []


def test_audit_in_small_pieces(docs, rows, monkeypatch):
    monkeypatch.setattr(divergence, "HELD_TERMS", 5)
    monkeypatch.setattr(divergence, "CELLS", 12)
    assert sorted(map(tuple, divergence.divergence_audit(docs).collect())) == brute_audit(rows)


def test_shares_are_exact_beyond_64_bits():
    n, total = np.array([0, 5, 10**16, 123456789012345678]), np.array([7, 10**17, 3 * 10**16 + 1, 123456789012345680])
    assert divergence.exact_shares(n, total).tolist() == [1 + 10**9 * (int(a) + 2) // int(b) for a, b in zip(n, total, strict=True)]


DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_pivot_collocations", "op13_vector_divergence"])
def test_same_as_sql(spark, name):
    import duckdb

    from gridloom.llm.queries import ORACLES, QUERIES

    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want, got = duck.sql(ORACLES[name]), QUERIES[name](spark, DATA)
    rows = sorted(map(tuple, got.select(*want.columns).collect()))
    assert rows and rows == sorted(want.fetchall())


def test_mix_of_the_table(spark):
    from gridloom.llm.queries import QUERIES

    got = QUERIES["op12_budget_mix"](spark, DATA)
    sources = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "source")
    sums = got.join(sources, "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.sum("size").alias("size"), F.first("source_size").alias("source_size"), F.collect_list("size").alias("sizes")).collect()
    for r in sums:
        assert r.size == r.source_size == sum(r.sizes)
        left, reach = r.target - r.target // r.size * r.size, {0}
        for s in r.sizes:
            reach |= {s + t for t in reach}
        assert abs(r.taken - r.target) <= min(abs(t - left) for t in reach) + 1  # as near as any choice of documents
    assert {r.source: r.target for r in sums} == pytest.approx(shares({r.source: r.size for r in sums}))
