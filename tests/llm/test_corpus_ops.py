"""Operators across rows, against brute force."""

import collections
import hashlib
import random

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from castellan.llm import chat, common, exact_dedup, pii, quality, queries, sais, simhash, suffix, urlfilter, warc

SF = "/root/testdata/sf0.001"


def oracle(sql, **tables):
    c = duckdb.connect()
    for name in ("documents", "pages"):
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    r = c.sql(sql)
    return sorted(str([None if v is None else str(v) for _, v in sorted(zip(r.columns, row))]) for row in r.fetchall())


def spark_rows(df):
    return sorted(str([None if r[c] is None else str(r[c]) for c in sorted(df.columns)]) for r in df.collect())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    assert spark_rows(queries.queries()[name](spark, SF)) == oracle(queries.oracle_sql()[name])


# --- exact dedup ---


def test_cuckoo_index_against_a_dict():
    r, index, held = random.Random(3), exact_dedup.CuckooIndex(2), {}
    for step in range(20_000):
        d = hashlib.sha256(str(r.randint(0, 3000)).encode()).digest()
        assert (index.find(d) >= 0) == (d in held)
        if d not in held:
            index.insert(d, step)
            held[d] = step
        elif r.random() < 0.4:
            assert index.delete(d)
            del held[d]
    assert dict(index.items()) == held and index.n == len(held) and not index.delete(b"x" * 32)


def test_cuckoo_false_hits_are_refuted():
    index = exact_dedup.CuckooIndex(4)
    a = b"\x01" * 10 + b"a" * 22
    index.insert(a, 1)
    assert index.find(b"\x01" * 10 + b"b" * 22) == -1 and index.find(a) >= 0


def test_exact_dedup_rows(odd, clashing, nothing, odd_rows):
    groups = collections.defaultdict(list)
    for d, t in odd_rows:
        groups[t].append(d)
    want = collections.Counter((d, max(groups[t]), len(groups[t]), d == max(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for d, t in odd_rows)
    assert collections.Counter(map(tuple, exact_dedup.members(clashing).collect())) == want
    assert exact_dedup.members(nothing).count() == 0
    kept = exact_dedup.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == sorted({d for d, t in odd_rows if d == max(groups[t])})
    assert {r.id for r in exact_dedup.classes(exact_dedup.digests(odd, "doc_id", "text"), "min").collect()} == {min(g) for g in groups.values()}


def test_contents_decide_where_digests_clash(spark, monkeypatch):
    """With a digest of one letter, most different texts clash."""
    monkeypatch.setattr(exact_dedup, "digest_of", lambda c: F.encode(F.substring(F.md5(common.text_or_empty(c)), 1, 1), "utf-8"))
    rows = [(k, f"text {k % 23}") for k in range(100)] + [(200, None), (201, ""), (201, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit(1))
    groups = collections.defaultdict(list)
    for d, t in rows:
        groups[t or ""].append(d)
    got = collections.Counter((r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.members(df).collect())
    assert got == collections.Counter((d, max(groups[t or ""]), len(groups[t or ""])) for d, t in rows)
    assert sorted(r.doc_id for r in exact_dedup.keep_one(df).collect()) == sorted(max(g) for g in groups.values())


def test_rows_apart(spark):
    df = spark.range(5000).withColumn("__page", F.lit(1)).drop("__page")
    marks = spark.range(0, 5000, 7).select(F.xxhash64("id").alias("h"))
    hit, rest = common.apart(df, F.xxhash64("id"), marks, 715)
    some, others = {r.id for r in hit.collect()}, {r.id for r in rest.collect()}
    assert not some & others and len(some | others) == 5000 and set(range(0, 5000, 7)) <= some and len(some) < 1500
    assert common.apart(df, F.xxhash64("id"), marks, 1 << 40)[1] is None


def test_full_indexes_are_handed_on(spark, monkeypatch):
    df = spark.createDataFrame([(k, f"t{k % 700}") for k in range(3000)], "doc_id long, text string").coalesce(1)
    fold = exact_dedup._fold("max", True)
    monkeypatch.setattr(exact_dedup, "MOST", 64)
    batches = [b for b in fold(iter(exact_dedup.digests(df, "doc_id", "text").selectExpr("digest", "id", "1L as n").toArrow().to_batches(max_chunksize=100)))]
    assert sum(sum(b.column(2).to_pylist()) for b in batches) == 3000 and len(batches) > 5


def test_repeated_ids_are_judged_by_row(spark):
    good, bad = " ".join(f"w{k}" for k in range(30)), "x"
    df = spark.createDataFrame([(5, good, "s"), (5, bad, "s"), (5, good, "t"), (7, bad, "s"), (None, good, "s")], "doc_id long, text string, source string")
    assert sorted(map(str, ((r.doc_id, r.text) for r in quality.keep_good(df).collect()))) == sorted(map(str, [(5, good), (5, good), (None, good)]))
    kept = exact_dedup.keep_one(df).collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept))) == sorted(map(str, [(5, good), (7, bad)]))
    assert simhash.keep_one(df, words=1).count() >= 2 and pii.redact(df).count() == 5


def test_null_ids(spark):
    df = spark.createDataFrame([(None, "x"), (3, "x"), (None, "y")], "doc_id long, text string")
    assert collections.Counter((r.doc_id, r.keep_id, r.kept) for r in exact_dedup.members(df).collect()) == {(None, 3, False): 1, (3, 3, True): 1, (None, None, True): 1}


def test_replay(spark):
    d = lambda k: bytearray(hashlib.sha256(k.encode()).digest())
    log = [(d("a"), "insert"), (d("b"), "insert"), (d("a"), "insert"), (d("b"), "delete"), (d("c"), "delete"), (None, "insert"), (d("c"), "insert"), (d("c"), "insert"), (d("e"), "other")]
    live = exact_dedup.replay(spark.createDataFrame(log, "digest binary, op string"))
    assert {bytes(r.digest): r.n for r in live.collect()} == {bytes(d("a")): 2, bytes(d("c")): 1}


# --- SimHash ---


def fingerprint(text, words=3):
    b = bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode()).split()
    if not b:
        return 0
    shingles = [b" ".join(b[i : i + words]) for i in range(len(b) - words + 1)] or [b" ".join(b)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(prints, radius):
    by = collections.defaultdict(list)
    for d, f in prints:
        by[f].append(d)
    fps = list(by)
    forest = common.Forest(len(fps))
    u = np.array(fps, dtype=np.uint64)
    for k in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(u[:k] ^ u[k]) <= radius):
            forest.union(int(j), k)
    least = {}
    for k, f in enumerate(fps):
        r = forest.find(k)
        least[r] = min(least.get(r, 1 << 62), min(by[f]))
    return {f: least[forest.find(k)] for k, f in enumerate(fps)}


def test_simhash_query(spark, doc_rows):
    prints = [(d, fingerprint(t)) for d, t in doc_rows]
    comp = brute_components(prints, 2)
    assert {tuple(r) for r in queries.op4_simhash(spark, SF).collect()} == {(d, f"{f:016x}", comp[f]) for d, f in prints}


def test_simhash_odd_rows(clashing, nothing, odd_rows):
    prints = [(d, fingerprint(t)) for d, t in odd_rows]
    comp = brute_components(prints, 2)
    got = simhash.components(clashing, words=3, radius=2)
    assert collections.Counter((r.id, r.f0 & (1 << 64) - 1, r.component) for r in got.collect()) == collections.Counter((d, f, comp[f]) for d, f in prints)
    assert simhash.components(nothing).count() == 0 and simhash.keep_one(nothing).count() == 0


@pytest.mark.parametrize(("tile_rows", "radius"), [(1 << 16, 2), (7, 2), (1 << 16, 3)])
def test_links_lose_nothing(spark, tile_rows, radius):
    r = random.Random(5)
    fps = {0, (1 << 64) - 1, 1}
    while len(fps) < 400:
        f = r.getrandbits(64)
        for _ in range(r.randint(1, 6)):
            fps.add(f)
            f ^= 1 << r.randrange(64)
    rows = [(k, 10, f - (1 << 64) if f >> 63 else f) for k, f in enumerate(sorted(fps))]
    reps = spark.createDataFrame(rows, "rep long, n long, f0 long")
    edges = simhash.links(reps, 1, radius, tile_rows=tile_rows)
    got = {x.node: x.component for x in common.connected_components(edges).collect()}
    want = brute_components([(k, f & (1 << 64) - 1) for k, _, f in rows], radius)
    assert {k: got.get(k, k) for k, _, _ in rows} == {k: want[f & (1 << 64) - 1] for k, _, f in rows}


def test_near_copies_go_and_others_stay(spark):
    r = random.Random(1)
    words = lambda n: [r.choice("abcdefghij") + str(r.randrange(500)) for _ in range(n)]
    rows, near = [], set()
    for k in range(60):
        base = words(300)
        rows.append((10 * k, " ".join(base)))
        for c in range(k % 3):
            copy = base[:]
            for i in r.sample(range(300), 3):  # five words a shingle: at most 15 of 296 change
                copy[i] = "changed" + str(r.randrange(1000))
            rows.append((10 * k + 1 + c, " ".join(copy)))
            near.add(10 * k + 1 + c)
    half = words(150)
    rows += [(900, " ".join(half + words(150))), (901, " ".join(half + words(150)))]  # a third alike: both stay
    kept = {x.doc_id for x in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {d for d, _ in rows} - near


def test_near_copies_that_repeat_a_line_go(spark):
    r = random.Random(3)
    words = lambda n: " ".join(f"w{r.randrange(100_000)}" for _ in range(n))
    rows, near = [], set()
    for k in range(40):
        body, line = words((300, 1000)[k % 2]), words(10)
        rows += [(10 * k, f"{body}\n{line}"), (10 * k + 1, "\n".join([body] + [line] * (7 + k % 6)))]
        near.add(10 * k + 1)
    kept = {x.doc_id for x in simhash.keep_one(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert kept == {d for d, _ in rows} - near


def test_candidates_lose_no_pair(spark):
    """Pairs about the bound, found as by brute force."""
    r = random.Random(4)
    rows = []
    for k in range(120):
        base = [f"w{r.randrange(100_000)}" for _ in range(r.choice((24, 60, 250, 357, 600)))]
        rows.append((10 * k, " ".join(base)))
        for c in range(3):
            n = len(base) - 4
            at, copy = r.randrange(len(base)), base[:]
            copy[at:at] = [f"w{r.randrange(100_000)}" for _ in range(max(1, round(n * r.uniform(0.08, 0.27)) - 4))]
            rows.append((10 * k + 1 + c, " ".join(copy)))
    sets = {d: set(simhash.shingle_hashes(t.encode(), 5).tolist()) for d, t in rows}
    forest = common.Forest(2000)
    for a in sets:
        for b in range(a // 10 * 10, a):
            if b in sets and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                forest.union(a, b)
    kept = {x.doc_id for x in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {d for d in sets if forest.find(d) == d} and 130 < len(kept) < 470


def test_connected_components(spark):
    r = random.Random(2)
    edges = [(k, k + 1) for k in range(100, 160)] + [(r.randrange(1000, 1400), r.randrange(1000, 1400)) for _ in range(300)] + [(5000, 5000 + k) for k in range(50)] + [(7, 7)]
    forest = common.Forest(6000)
    for a, b in edges:
        forest.union(a, b)
    got = common.connected_components(spark.createDataFrame(edges, "a long, b long"))
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert {x.node: x.component for x in got.collect()} == {x: forest.find(x) for x in nodes}
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- suffix arrays ---


def brute_runs(rows, length):
    """Which places of each row lie in a string of that length that starts elsewhere as well."""
    times = collections.Counter(tuple(b[i : i + length]) for b in rows for i in range(len(b) - length + 1))
    out = []
    for b in rows:
        edge = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if times[tuple(b[i : i + length])] > 1:
                edge[i] += 1
                edge[i + length] -= 1
        gone = np.cumsum(edge)[: len(b)] > 0
        runs = int((np.diff(np.concatenate([[0], gone.astype(int), [0]])) == 1).sum())
        out.append((gone, runs))
    return out


def brute_cut(rows, length, words=51):
    out = collections.Counter()
    cuts = brute_runs([b for _, b in rows], length)
    passages = brute_runs([b.split() for _, b in rows], words)
    for (d, b), (gone, runs), (shared, n) in zip(rows, cuts, passages):
        out[d, len(b), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest(), n, int(shared.sum())] += 1
    return out


def cut_rows(df):
    """Rows of a result as ``brute_cut`` has them; one that did not look for passages has none."""
    passages = "n_passages" in df.columns
    return collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.n_passages if passages else 0, r.n_passage_words if passages else 0) for r in df.collect())


def test_suffix_query(spark, doc_rows):
    assert cut_rows(queries.op9_suffix_dedup(spark, SF)) == brute_cut([(d, t.encode()) for d, t in doc_rows], 400, 1 << 40)


def test_suffix_odd_rows(clashing, nothing, odd_rows):
    rows = [(d, (t if len(t) < 9000 else t[:0]).encode()) for d, t in odd_rows]
    small = clashing.withColumn("text", F.when(F.length("text") < 9000, F.col("text")))
    assert cut_rows(suffix.report(small)) == brute_cut(rows, 400, 1 << 40)
    assert suffix.report(nothing).count() == 0
    whole = {(r.doc_id, r.n_removed) for r in suffix.report(clashing).collect()}
    assert (6, 240_000) in whole


@pytest.mark.parametrize("hot", [20_000, 1])
def test_passages_in_many_contexts(spark, hot):
    r = random.Random(4)
    w = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage, shorter = w(700), w(390)
    rows = [(k, (w(r.randint(0, 500)) + (passage if k % 2 else shorter) + w(r.randint(0, 500)) + ("" if k % 5 else passage[100:600])).encode()) for k in range(60)]
    rows += [(100, b"ab" * 600), (101, b"x" * 399), (102, b"x" * 400), (103, rows[3][1])]
    df = spark.createDataFrame([(d, b.decode()) for d, b in rows], "doc_id long, text string")
    got = suffix.cut_documents(df, hot_regions=hot).select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passages", "n_passage_words")
    assert cut_rows(got) == brute_cut(rows, 400)


@pytest.mark.parametrize("hot", [2_000, 1])
def test_passages_of_over_fifty_words(spark, hot):
    """Shorter than 400 bytes, so nothing goes, but reported; fifty words and less are not."""
    r = random.Random(9)
    w = lambda n: " ".join("".join(r.choice("abcd") for _ in range(r.randint(1, 3))) + str(r.randrange(90)) for _ in range(n))
    passage, shorter = w(51), w(50)
    rows = [(k, f"{w(r.randint(0, 40))} {(passage, shorter, w(60))[k % 3]}\n{w(r.randint(0, 40))}".encode()) for k in range(45)]
    rows += [(100, b"a " * 200), (101, passage.replace(" ", "\n\t").encode()), (102, b"")]
    df = spark.createDataFrame([(d, b.decode()) for d, b in rows], "doc_id long, text string")
    got = suffix.cut_documents(df, hot_regions=hot).select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passages", "n_passage_words")
    want = brute_cut(rows, 400)
    assert cut_rows(got) == want and sum(k[5] for k in want) >= 17


def test_induced_sorting():
    rng = np.random.default_rng(1)
    for t in range(150):
        n, k = int(rng.integers(1, 700)), int(rng.integers(1, 5 if t % 2 else 200))
        x = rng.integers(1, k + 1, size=n)
        if t % 5 == 0:
            x = np.tile(x[: max(1, n // 7)], 8)
        s = np.append(x, 0)
        flat = s.tolist()
        sa = sais.suffix_array(s, int(s.max()) + 1).tolist()
        assert sa == sorted(range(len(flat)), key=lambda i: flat[i:])
        plcp = sais.permuted_lcp(s, np.array(sa))
        for a, b in zip(sa, sa[1:]):
            h = 0
            while a + h < len(flat) and b + h < len(flat) and flat[a + h] == flat[b + h]:
                h += 1
            assert plcp[b] == h


def test_long_texts_go_in_segments(monkeypatch):
    data = bytes(random.Random(6).choices(b"abc", k=9000))
    whole = suffix.regions(data)
    monkeypatch.setattr(suffix, "SEGMENT", 1000)
    parts = suffix.regions(data)
    starts = lambda rs: [(a + i, a + d, key) for a, n, d, key in rs for i in range(n)]
    assert starts(parts) == starts(whole) and [s for s, *_ in starts(whole)] == list(range(9000 - 399))


# --- URLs ---


def test_url_rules(spark):
    urls = ["http://a.NET/x", "http://net", "http://Example.net/en/5?q#f", "https://example.net/de/", "http://m.example.com/de/", "http://notexample.com/de/", "http://x.org/fr/1", "no scheme", None, "", "http://", "http://.net/", "http://u@x.net:80/", "http://a.net?/x", "ftp://b.example.com/de", "http://x.net/\n/y"]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), urlfilter.rules_table(spark)).collect()}
    want = {}
    for k, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = rest[:cut].lower(), rest[cut:].split("?")[0].split("#")[0]
        fits = [(h + p, v) for v, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, "allow"))
        want[k] = (host, path, rule, verdict)
    assert got == want


def test_url_rule_precedence_and_edges(spark):
    rules = spark.createDataFrame([("block", "a.b", "/"), ("allow", "a.b", "/x"), ("allow", "b", "/xyz"), ("block", "b", "/xyz"), (None, "b", "/"), ("block", "a.b", "/x")], "verdict string, host string, path string")
    pages = spark.createDataFrame([(1, "http://a.b/xq", "z"), (1, "http://a.b/xq", "z"), (2, "http://c.b/xyz", "z"), (3, "http://q.a.b/", "z")], "page_id long, url string, host string")
    got = sorted((r.page_id, r.rule, r.verdict) for r in urlfilter.judge(pages, rules).collect())
    assert got == [(1, "a.b/x", "block"), (1, "a.b/x", "block"), (2, "b/xyz", "block"), (3, "a.b/", "block")]
    assert urlfilter.judge(pages, rules.where("false")).where("verdict = 'allow' and rule is null").count() == 4
    assert urlfilter.judge(pages.where("false"), rules).count() == 0


# --- revisits ---


def test_revisits(spark):
    schema = "record_id long, url string, ts long, kind string, etag string, last_modified string, digest string, headers map<string,string>"
    h = {"content-type": "t", "etag": "old", "date": "1"}
    rows = [
        (1, "http://www.A.com/p/?b=1&a=2&utm_x=3#f", 10, "response", '"v"', None, "d", h),
        (2, "https://a.com:443/p?a=2&b=1", 5000, "revisit", 'W/"v"', None, None, {"date": "2", "content-length": "0", "etag": "new"}),
        (3, "a.com/p?a=2&b=1", 10, "revisit", '"v"', None, None, {}),  # not later than the response
        (4, "http://a.com/p?b=1&a=2", 11, "revisit", '"w"', None, None, {}),
        (5, "http://a.com/q", 11, "revisit", None, None, "d", None),
        (6, "http://a.com/q", 3, "response", None, "m", "d", None),
        (7, "http://a.com/q", 3, "response", None, "m", "d", h),
        (8, None, 11, "revisit", None, None, None, None),
        (9, "http://a.com/p?b=1&a=2", None, "revisit", None, None, None, None),
        (10, "http://a.com/q", 9000, "revisit", None, None, None, None),
    ]
    got = {r.record_id: (r.target_id, r.outcome, r.headers) for r in warc.resolve(spark.createDataFrame(rows, schema)).collect()}
    assert got[2] == (1, "resolved", {"content-type": "t", "etag": "new", "date": "2"})
    assert got[3][:2] == (None, "missing") and got[4][:2] == (1, "mismatch") and got[5] == (7, "resolved", h)
    assert got[8][1] == got[9][1] == "missing" and got[10][:2] == (7, "unverified")
    assert warc.resolve(spark.createDataFrame([], schema)).count() == 0


def test_hot_url_as_of_join(spark):
    r = random.Random(8)
    rows = [(k, "http://x.y/" if k % 3 else f"http://x.y/{k % 7}", r.randrange(400), "response" if r.random() < 0.3 else "revisit", "e", None, None, {}) for k in range(600)]
    df = spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, etag string, last_modified string, digest string, headers map<string,string>")
    want = {k: max(((t, j) for j, v, t, kind, *_ in rows if kind == "response" and v == u and t < ts), default=(None, None))[1] for k, u, ts, what, *_ in rows if what == "revisit"}
    assert {x.record_id: x.target_id for x in warc.resolve(df, bucket=16).collect()} == want


def test_revisits_of_repeated_pages(spark):
    """Two equal rows give two answers, and clashing or missing columns change nothing."""
    pages = [(k, f"http://h{k % 2}.net/{k % 3}", f"<p>{k}") for k in range(1, 40)]
    odd = [(50, None, "x"), (51, "no scheme", None), (52, "http://h0.net/" + "a" * 50_000 + "?q=" + "b" * 50_000, "y"), (53, "", ""), (-3, "http://h0.net/1", "z")]
    schema = "page_id long, url string, html string"
    df = spark.createDataFrame(pages + odd, schema)
    one = collections.Counter(map(str, warc.report(df).collect()))
    assert sum(one.values()) == 44
    clash = df.union(df).withColumns({n: F.lit("clash") for n in ("rid", "tag", "bucket", "kind", "ts", "record_id")})
    two = warc.report(clash).collect()
    assert collections.Counter(r.record_id for r in two) == {k: 2 for k in {r.record_id for r in two}}
    assert {(r.record_id, r.outcome, r.target_id) for r in two} == {(r.record_id, r.outcome, r.target_id) for r in warc.report(df).collect()}
    assert warc.report(df.where("false")).count() == 0


def test_every_outcome_occurs(spark):
    got = collections.Counter(r.outcome for r in queries.op10_warc(spark, SF).collect())
    assert set(got) == {"resolved", "mismatch", "unverified", "missing"}


# --- transcripts ---


def test_chat_recovers_roles(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    turns = chat.report(table).collect()
    first = {(r.conv_id, r.turn): r for r in turns if r.piece == 0}
    truth = {(r.conv_id, r.turn): r for r in table.collect()}
    assert set(first) == set(truth)
    right = sum(first[k].role == truth[k].role and first[k].starts for k in truth)
    assert right / len(truth) > 0.95
    for k, r in first.items():
        marked = (k[0] + k[1]) % 5 != 4
        if marked and r.starts:
            assert r.rendered.startswith(f"<|{r.role}|>\n") and (truth[k].text or "").strip("\n").startswith(r.rendered.split("\n", 1)[1][:20].strip("\n"))


def features_of(chunks):
    return [row for text in chunks for row in chat.line_features(text.split("\n")).tolist()]


def textbook_viterbi(model, f):
    """Score and states of lines with features ``f``, line by line with plain numbers."""
    said = lambda k, s: sum(float(model.emit[j][s][f[k][j]]) for j in range(4))
    best = [[(float(model.first[s]) + said(0, s), [s]) for s in range(6)]]
    for k in range(1, len(f)):
        row = []
        for s in range(6):
            score, path = max(((best[-1][p][0] + float(model.step[p][s]), best[-1][p][1]) for p in range(6)), key=lambda x: x[0])
            row.append((score + said(k, s), path + [s]))
        best.append(row)
    return max(best[-1], key=lambda x: x[0])


def score_of(model, f, states):
    total = float(model.first[states[0]])
    for k, s in enumerate(states):
        total += sum(float(model.emit[j][s][f[k][j]]) for j in range(4)) + (float(model.step[states[k - 1]][s]) if k else 0.0)
    return total


def test_chat_against_textbook_viterbi(spark):
    """Every conversation's pieces follow a best path, whole and in small blocks."""
    import itertools

    table = spark.read.parquet(f"{SF}/conversations.parquet")
    chunks = chat.transcripts(table)
    rows, start = chat.training_rows(chunks)
    model = chat.fit(rows, start)
    held = collections.defaultdict(list)
    for r in chunks.collect():
        held[r.conv_id].append((r.turn, r.text or ""))
    for block in (chat.BLOCK, 2):
        got = collections.defaultdict(list)
        for r in chat.parse(chunks, model, block=block).collect():
            got[r.conv_id].append((r.turn, r.piece, r.role, r.starts, r.n_lines))
        assert set(got) == set(held)
        for conv, turns in held.items():
            lines = features_of(text for _, text in sorted(turns))
            states = []
            for _, _, role, starts, n in sorted(got[conv]):
                at = 2 * chat.ROLES.index(role)
                states += [at + (not starts), *[at + 1] * (n - 1)]
            score, path = textbook_viterbi(model, lines)
            assert states == path or abs(score_of(model, lines, states) - score) < 1e-9
    lines = features_of(["User: a?\nb\n", "AI: c."])
    score, _ = textbook_viterbi(model, lines)
    with np.errstate(invalid="ignore"):
        assert abs(max(score_of(model, lines, p) for p in itertools.product(range(6), repeat=4)) - score) < 1e-9


def test_chat_crowded_blocks(spark):
    """Many rows of one turn, null turns and null conversations, against one block of all."""
    model = chat.fit([(c, k, t, "user" if k % 2 == 0 else "assistant") for c in range(30) for k, t in enumerate(["User: hi\nthere", "Assistant: hello"] * 2)])
    rows = [(7, 3, "User: x\ny")] * 40 + [(7, 3, f"A: {k}") for k in range(30)] + [(7, None, "Q: n")] * 9 + [(None, 1, "AI: b"), (-1, 1, "AI: c"), (None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    got = chat.parse(df, model, block=4, crowded=8).collect()
    assert collections.Counter((r.conv_id, r.turn) for r in got if r.piece == 0) == collections.Counter((c, t) for c, t, _ in rows)
    assert {r.rendered for r in got if r.conv_id is None and r.turn == 1} == {"<|assistant|>\nb"} and {r.rendered for r in got if r.conv_id == -1} == {"<|assistant|>\nc"}
    few, start = chat.training_rows(df.withColumn("role", F.lit("user")), most=5)
    assert 0 < len(few) <= 10 and start == 1
    assert chat.training_rows(df.where("false").withColumn("role", F.lit("user"))) == ([], None)


def test_chat_report_edges(spark):
    schema = "conv_id long, turn long, role string, text string, conv string, known string, block string"
    assert chat.report(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, 0, "user", "hi", "x", "y", "z"), (1, 0, "user", "hi", "x", "y", "z"), (None, None, None, None, None, None, None), (2, 1, "other", "word " * 20_000, "x", "y", "z")]
    got = chat.report(spark.createDataFrame(rows, schema)).collect()
    assert collections.Counter((r.conv_id, r.turn) for r in got if r.piece == 0) == {(1, 0): 2, (None, None): 1, (2, 1): 1}


def test_chat_blocks_equal_one_block(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet").withColumn("conv_id", F.lit(1)).withColumn("turn", F.monotonically_increasing_id())
    chunks = chat.transcripts(table).cache()
    model = chat.fit([(r.conv_id, r.turn, r.text, r.role) for r in chunks.collect()])
    cols = ["turn", "piece", "role", "starts", "rendered"]
    whole = {tuple(r) for r in chat.parse(chunks, model, block=1 << 40).select(*cols).collect()}
    assert {tuple(r) for r in chat.parse(chunks, model, block=3).select(*cols).collect()} == whole


def test_chat_edges(spark):
    model = chat.fit([])
    rows = [(1, 0, "User: hi\nthere\nAssistant: hello"), (1, 1, None), (None, None, ""), (1, 1, "Q: x"), (1, 1, "Q: x"), (2, 0, "word " * 5000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string").withColumn("role", F.lit("clash")).withColumn("block", F.lit(1))
    got = chat.parse(df, model).collect()
    assert sum(r.n_lines for r in got) == 3 + 5 and chat.parse(df.where("false"), model).count() == 0
    model = chat.fit([(c, k, t, "user" if k % 2 == 0 else "assistant") for c in range(30) for k, t in enumerate(["User: hi\nthere", "Assistant: hello"] * 2)])
    got = chat.parse(df.where("conv_id = 1 and turn = 0"), model).orderBy("piece").collect()
    assert [(r.role, r.rendered) for r in got] == [("user", "<|user|>\nhi\nthere"), ("assistant", "<|assistant|>\nhello")]
