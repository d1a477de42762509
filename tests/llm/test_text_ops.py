"""Operators on one text at a time, against plain forms of their contracts."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from castellan.llm import bpe, oracles, packing, pii, quality, queries

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def plain_base(text):
    spans = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            spans.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c in "0123456789"]
        if 14 <= len(d) <= 19 and sum(x if k % 2 == 0 else (x * 2 if x < 5 else x * 2 - 9) for k, x in enumerate(d[::-1])) % 10 == 0:
            spans.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c in "0123456789" for c in m.group()) <= 15:
            spans.append((m.start(), 3, m.end()))
    return sorted(spans)


ALPHABET = "a1@.+- (%_)\n4é5"


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=ALPHABET, max_size=60))
def test_base_spans(text):
    assert pii.base_spans(text) == plain_base(text)


def check_pii(got, rows):
    want = collections.Counter()
    for d, text in rows:
        b = plain_base(text)
        want[d, *(sum(k == x for _, k, _ in b) for x in range(4)), hashlib.sha256(",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in b).encode()).hexdigest()] += 1
    assert collections.Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got.collect()) == want


def test_pii_query(spark, doc_rows, odd, clashing, nothing, odd_rows):
    check_pii(queries.op1_pii(spark, "/root/testdata/sf0.001"), doc_rows)
    check_pii(pii.report(clashing), odd_rows)
    assert pii.report(nothing).count() == 0 and pii.redact(odd).count() == len(odd_rows)


def field_score(documents):
    """Found and all entities by kind, and the decoys that got a span, of (text, [(start, end, label)])."""
    w, hit, total, wrong = pii.weights(), collections.Counter(), collections.Counter(), 0
    for text, truth in documents:
        [(base, added)] = pii.find([text], w)
        assert base == plain_base(text)
        for a, b, label in truth:
            if not label:
                wrong += any(s < b and a < e for s, _, e in added)
            elif label > 0 and not any(s <= a and b <= e for s, _, e in base):
                total[label] += 1
                hit[label] += any(k + 1 == label and s < b and a < e for s, k, e in added)
    return hit, total, wrong


def test_pii_field_on_unseen_sentences():
    r = random.Random(99)
    hit, total, wrong = field_score(pii._sentence(r) for _ in range(300))
    assert all(hit[k] >= 0.9 * total[k] for k in range(1, 5)) and wrong <= 0.02 * sum(total.values())


def letter(r):
    """A message in plain prose; its forms and words are none of the training's."""
    n = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    a, m, t, o = r.choice("23456789") + n(2), n(3), n(4), [str(r.randint(0, 255)) for _ in range(4)]
    card = next(c + d for c in [n(15)] for d in "0123456789" if pii.luhn(c + d))
    c = [card[k : k + 4] for k in (0, 4, 8, 12)]
    user, host = r.choice(["maria.lopez", "jens_k", "o.neil7", "info"]), r.choice(["mail.example.org", "firma.example.de"])
    entities = [
        (f"+1 ({a}) {m} {t}", [f"{a}/{m}-{t}", f"{a}.{m}-{t}", f"({a}) {m} {t}", f"{a}{m}-{t}", f"[{a}] {m}-{t}", f"{a} {m}{t}"], 4),
        (".".join(o), [",".join(o), "/".join(o), f"{o[0]}[.]{o[1]}.{o[2]}[.]{o[3]}", ":".join(o), f"[{'.'.join(o[:3])}[.]{o[3]}]"], 2),
        (" ".join(c), [".".join(c), f"{c[0]}{c[1]}/{c[2]}{c[3]}", "_".join(c), f"{card[:8]}.{card[8:]}"], 3),
        (f"{user}@{host}", [f"{user}[at]{host}", f"{user}(at){host.replace('.', '(dot)')}", f"<{user}[at]{host}>"], 1),
    ]
    decoys = [f"Rechnung {n(6)}", f"am {n(2)}.{n(2)}.19{n(2)}", f"order no. {n(3)}-{n(7)}", f"version {n(1)}.{n(2)}.{n(1)}", f"les {n(3)} pages", f"kod {n(16)}", f"um {n(2)}:{n(2)} Uhr"]
    prose = ["Please note that", "bitte melden Sie sich unter", "nous avons", "the shipment left with", "sin embargo", "wie besprochen", "we still have", "confirmed by", "siehe auch"]
    parts = [(x, 0) for x in r.sample(decoys, 4)]
    for full, forms, label in r.sample(entities, 2):
        parts += [(full, -1), *((f, label) for f in r.sample(forms, 2))]
    r.shuffle(parts)
    text, truth = "", []
    for part, label in parts:
        text += r.choice(prose) + " "
        truth.append((len(text), len(text) + len(part), label))
        text += part + r.choice([", ", ".\n", " "])
    return text, truth


def test_pii_field_on_other_texts():
    r = random.Random(5)
    hit, total, wrong = field_score(letter(r) for _ in range(400))
    assert all(hit[k] >= 0.9 * total[k] > 50 for k in range(1, 5)) and wrong <= 0.03 * sum(total.values())


def test_pii_is_linear_in_long_runs():
    import time

    for text in ("1" * 400_000, "1." * 200_000, "a" * 400_000, "a1" * 200_000, "@" * 300_000, "+1" + " " * 300_000, "12 " * 100_000, "a.b" * 100_000 + "@"):
        began = time.process_time()
        [(base, _)] = pii.find([text], pii.weights())
        assert time.process_time() - began < 20
    assert pii.base_spans("1.2.3.4.5.6.7.8.9") == plain_base("1.2.3.4.5.6.7.8.9")


def test_long_tokens_and_short_groups_are_nodes():
    text = "see 12[.]34[.]5[.]6, and 06 12 34 56 78 or " + "x1" * 100
    assert [text[s:e] for s, e, _ in pii.tokens(text, [])] == ["12[.]34[.]5[.]6", "06 12 34 56 78", "x1" * 100]
    far = "+1 (743) 555-3824 " + "then 743-555-3824 came up. " * 40
    [(_, added)] = pii.find([far], pii.weights())
    assert len(added) == 40


def test_distant_mentions_share_a_label(spark):
    text = "call +1 (743) 555-3824 soon. " + "filler words " * 50 + "or 743-555-3824 later, order 743-555-9999"
    [(base, added)] = pii.find([text], pii.weights())
    assert [text[s:e] for s, _, e in added] == ["743-555-3824"] and pii.KINDS[added[0][1]] == "phone"
    out = pii.redact(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert out[0].text.count("<PHONE>") == 2 and "9999" in out[0].text and out[1].text is None


# --- encoding ---

TIKTOKEN = None


def library():
    global TIKTOKEN
    if TIKTOKEN is None:
        b = bpe.load(P.path("byte_bpe_multi_50k.tiktoken"))
        TIKTOKEN = b, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=b.ranks, special_tokens={})
    return TIKTOKEN


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text(alphabet="abcdehinst éß漢 \n'1", max_size=200), st.integers(1, 300).map(lambda n: "ab" * n)))
def test_tree_encoding(text):
    tree, own = library()
    ids = np.frombuffer(tree.encode(text), "<u4").tolist()
    assert ids == own.encode_ordinary(text) and tree.decode(ids) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=120))
def test_joins_equal_one_merge(data):
    tree, _ = library()
    assert tree.tree(data) == tree.merge(data)


def check_bpe(got, rows):
    tree, own = library()
    want = collections.Counter()
    for d, t in rows:
        ids = own.encode_ordinary(t)
        want[d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()] += 1
    assert collections.Counter(map(tuple, got.collect())) == want


def test_bpe_query(spark, doc_rows, clashing, nothing, odd, odd_rows):
    check_bpe(queries.op5_bpe(spark, "/root/testdata/sf0.001"), doc_rows)
    check_bpe(bpe.round_trip(clashing, P.path(queries.RANKS)), odd_rows)
    assert bpe.round_trip(nothing, P.path(queries.RANKS)).count() == 0
    ids = bpe.encode_column(odd, P.path(queries.RANKS))
    back = bpe.decode_column(ids, P.path(queries.RANKS))
    assert sorted(bytes(r.bytes) for r in back.collect()) == sorted(t.encode() for _, t in odd_rows)


# --- packing ---


def check_packing(got, rows):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    encoded = t.encode_batch([x for _, x in rows], add_special_tokens=False)
    want = collections.Counter()
    total = 0
    for (d, _), e in zip(rows, encoded):
        ids = np.array([*e.ids, 0], "<u4")
        total += len(ids)
        first = len(ids) if len(ids) <= 2048 else len(ids) % 2048 or 2048
        bounds = [0, *range(first, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
            want[d, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    found = got.collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == want
    bins = collections.defaultdict(list)
    for r in found:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= 2048
    return len(bins), total


def test_packing_query(spark, doc_rows, clashing, nothing, odd_rows):
    bins, total = check_packing(queries.op3_packing(spark, "/root/testdata/sf0.001"), doc_rows)
    assert bins <= 1.005 * total / 2048 + 1
    check_packing(packing.pack_documents(clashing, P.path(queries.VOCABULARY)), odd_rows)
    assert packing.pack_documents(nothing, P.path(queries.VOCABULARY)).count() == 0


def test_packing_ids_of_special_strings(spark):
    rows = [(1, "a<|endoftext|>b"), (2, "<|endoftext|>"), (3, "<|endoftext|><|endoftext|> x"), (4, "<|endoftext|"), (5, "\n <|endoftext|>\n"), (6, "<|EndOfText|> é")]
    check_packing(packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), P.path(queries.VOCABULARY)), rows)


def test_packing_in_shards(spark, docs, doc_rows):
    rows = packing.pieces(docs, P.path(queries.VOCABULARY))
    whole, total = check_packing(packing.pack(rows, open_bins=8, shard=40), doc_rows)
    assert whole <= 1.1 * total / 2048 + 2


def test_fullest_bin_closes_first():
    fit = packing.BestFit(10, 2)
    assert fit.place(6) == (0, 0) and fit.place(7) == (1, 0) and fit.place(8) == (2, 0)  # bin 1, the fullest, closed
    assert fit.place(3) == (0, 6) and fit.place(2) == (2, 8)


@pytest.mark.parametrize(("n", "want"), [(1, [(0, 1)]), (5, [(0, 5)]), (6, [(0, 1), (1, 5)]), (10, [(0, 5), (5, 5)])])
def test_cuts(n, want):
    assert packing.cuts(n, 5) == want


# --- quality ---


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times = collections.Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n# é", max_size=120))
def test_counts(text):
    assert quality.counts(text.encode()) == plain_counts(text)


def check_quality(got, rows):
    want = collections.Counter()
    for d, t in rows:
        c = plain_counts(t)
        want[d, *c, c[0] < 20 or 100 * c[4] > 30 * c[0]] += 1
    found = got.collect()
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found) == want
    assert not any(r.kept and r.base_failed for r in found)
    return found


def test_quality_query(spark, doc_rows, odd, clashing, nothing, odd_rows):
    found = check_quality(queries.op6_quality(spark, "/root/testdata/sf0.001"), doc_rows)
    assert all(r.kept for r in found if not r.base_failed)  # no host of the table is bad
    check_quality(quality.judged(clashing).withColumnRenamed("id", "doc_id"), odd_rows)
    assert quality.judged(nothing).count() == 0 and quality.keep_good(nothing).count() == 0 and quality.keep_good(odd).columns == odd.columns


def test_hosts_change_verdicts(spark):
    """A host most of whose documents fail takes the others along; SQL says the same."""
    import duckdb
    import pandas as pd

    r = random.Random(2)
    rows = []
    for host, n, rate in [("a", 300, 0.05), ("b", 300, 0.1), ("c", 200, 0.2), ("d", 40, 0.0), ("bad", 200, 0.85), ("worse", 100, 1.0), ("tiny", 2, 1.0), (None, 50, 0.9)]:
        rows += [(len(rows) + k, "short text" if r.random() < rate else " ".join(f"w{r.randrange(9000)}" for _ in range(30)), host) for k in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {x.id: (x.base_failed, x.kept) for x in quality.judged(df).collect()}
    of = {d: h for d, _, h in rows}
    turned = {of[d] for d, (failed, kept) in got.items() if not failed and not kept}
    assert turned == {"bad"} and all(kept for d, (failed, kept) in got.items() if not failed and of[d] != "bad")
    c = duckdb.connect()
    c.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "source"]))
    assert {x["doc_id"]: (x["base_failed"], x["kept"]) for x in c.sql(oracles.QUALITY).df().to_dict("records")} == got
    assert {x.doc_id for x in quality.keep_good(df).collect()} == {d for d, (_, kept) in got.items() if kept}


def test_hosts(spark):
    rows = [("bad", True)] * 400 + [("good", False)] * 900 + [("good", True)] * 100 + [("small", True)] * 2 + [(None, True)] * 3
    v = {r.host: r for r in quality.host_verdicts(spark.createDataFrame(rows, "host string, base_failed boolean")).collect()}
    assert not v["bad"].host_ok and v["good"].host_ok and v["small"].host_ok and None not in v
    assert v["small"].rate < 1.0 and v["bad"].rate > 0.97
    assert quality.beta_prior(0, 0, 0, 0.0, 0.0) == (1.0, 1.0)
