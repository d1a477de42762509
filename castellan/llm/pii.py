"""Personal data by exact patterns plus a skip-chain conditional random field.

Base spans come from four fixed patterns. The random field then labels what
else could be personal data: every other token with a digit, ``@`` or ``[at]``,
whatever its length, where groups of digits on a line count as one token
(``(743) 555-3824``, ``06 12 34 56 78``). Neighbours on a line share chain
potentials, and distant tokens of one document that repeat or resemble each
other share skip potentials, so that ``(743) 555-3824`` takes its label from an
earlier ``+1 (743) 555-3824``. Base spans are observed nodes. Every node is
linked to one that it resembles, an observed one where there is any, so links
grow linearly and a label reaches all repeats. Sum-product messages loop over
each document's graph until no message moves by more than ``SETTLED``, or for
``ROUNDS`` rounds. Weights are fitted here, by pseudo-likelihood on generated
sentences (``TRAINING_SENTENCES`` of them, a documented bound).

Offsets count code points, ends are exclusive. Null texts count as empty and
have no spans. Repeated rows are handled row by row. All steps are linear in a
text, whatever runs of digits, dots or letters it holds.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import once

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns, kept as text.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: The same with whole runs of digits, so that a long run is read once.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

NOT_DIGIT = re.compile(r"[^0-9]")
DIGITS = re.compile(r"[0-9]+")
HINT = re.compile(r"[0-9]|@|[\[(][aA][tT][\])]")
AT, DOT = re.compile(r"[\[(]at[\])]", re.IGNORECASE), re.compile(r"[\[(]dot[\])]", re.IGNORECASE)
GROUP = re.compile(r"[+(\[]*[0-9][0-9()\[\].\-/_]*")  # a token that may be a part of a number
EDGES = ".,;:!?\"'*#$%&<>|=()[]{}"
LABELS = 5  # 0 is none, then KINDS in order
FEATURES = 20
SKIPS = 3  # same digits, same last seven digits, same address letters
TRAINING_SENTENCES = 1500
SURE = 0.6
ROUNDS, SETTLED = 100, 1e-4
SPAN_COLUMNS = "spans array<struct<kind:string,start:int,stop:int,base:boolean>>"


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if k % 2:
            v = v * 2 - 9 if v > 4 else v * 2
        total += v
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from each ``@`` outwards."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the four patterns, sorted."""
    out = [(s, 0, e) for s, e in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    out.sort()
    return out


def tokens(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Nodes (start, end, label): base spans with their label, candidates with -1."""
    nodes = []
    last = 0
    for s, k, e in base:
        if s >= last:
            nodes.append((s, e, k + 1))
            last = e
    taken = sorted((s, e) for s, _, e in base)
    done, t = 0, 0
    found: list[tuple[int, int]] = []
    for m in HINT.finditer(text):
        if m.start() < done:
            continue
        lo, hi = m.start(), m.end()
        while lo > done and not text[lo - 1].isspace():
            lo -= 1
        while hi < len(text) and not text[hi].isspace():
            hi += 1
        done = hi
        while lo < hi and text[lo] in EDGES and text[lo] not in "([":
            lo += 1
        while hi > lo and text[hi - 1] in EDGES and text[hi - 1] not in ")]":
            hi -= 1
        while t < len(taken) and taken[t][1] <= lo:
            t += 1
        if (t == len(taken) or taken[t][0] >= hi) and not (t and taken[t - 1][1] > lo) and hi > lo:
            found.append((lo, hi))
    nodes += [(s, e, -1) for s, e in joined_groups(text, found, {e for _, e in taken})]
    nodes.sort()
    return nodes


def joined_groups(text: str, found: list[tuple[int, int]], stops: set[int]) -> list[tuple[int, int]]:
    """Tokens, where groups of at most eight digits with one or two blanks between them join, up to 19 digits."""
    out: list[tuple[int, int]] = []
    room = 0  # digits that the last one can still take
    for s, e in found:
        n = sum(map(len, DIGITS.findall(text, s, e))) if e - s <= 16 and GROUP.fullmatch(text, s, e) else 0
        if not 0 < n <= 8:
            out.append((s, e))
            room = 0
        elif out and n <= room and text[out[-1][1] : s] in (" ", "  ") and out[-1][1] not in stops:
            out[-1] = (out[-1][0], e)
            room -= n
        else:
            out.append((s, e))
            room = 19 - n
    return out


def spelled(token: str) -> str:
    """A token with the spelled marks of addresses as characters."""
    return DOT.sub(".", AT.sub("@", token))


def features(token: str) -> list[int]:
    token = spelled(token)
    groups = DIGITS.findall(token)
    sizes = list(map(len, groups[:8]))
    n = sum(map(len, groups))
    letters = any(map(str.isalpha, token))
    plus, pure = token.startswith("+"), not letters
    quad = pure and len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups)
    national = pure and n >= 10 and sizes[-1:] in ([4], [7], [10]) and (sizes[-2:] == [3, 4] or len(groups) <= 3)
    pairs = pure and len(groups) == 5 and all(k == 2 for k in sizes)
    row = [
        True, n <= 2, 3 <= n <= 4, 5 <= n <= 6, 7 <= n <= 9, 10 <= n <= 13, 14 <= n <= 19, n >= 20, quad, "@" in token and letters, pure and any(c in "()" for c in token),
        letters and n > 0, 14 <= n <= 19 and luhn("".join(groups)), pure and len(groups) == 1, plus and 10 <= n <= 15, plus, sizes == [4, 4, 4, 4], national, pairs, len(groups) == 3 and n == 8,
    ]
    return list(map(int, row))


def keys(token: str) -> list[tuple[int, str]]:
    token = spelled(token)
    if "@" in token:
        return [(2, re.sub(r"[^a-z0-9]", "", token.lower()))]
    if any(map(str.isalpha, token)):
        return []
    digits = NOT_DIGIT.sub("", token)
    return [(0, digits)] * (len(digits) >= 4) + [(1, digits[-7:])] * (len(digits) >= 7)


class Graph:
    """Nodes, chain edges and skip edges of a batch of documents."""

    def __init__(self) -> None:
        self.feature: list[list[int]] = []
        self.label: list[int] = []
        self.plain: list[int] = []  # neighbours on the line that are ordinary words
        self.edges: list[tuple[int, int, int]] = []  # (i, j, type); type 0 chain, 1.. skip

    def add(self, text: str, nodes: list[tuple[int, int, int]]) -> int:
        """Add a document; a node has a skip edge to one other node at most, so links grow linearly.

        That is the first observed node with a key of its own, the closest key
        first; where there is none, the first node with its loosest key.
        """
        first = len(self.label)
        seen: dict[tuple[int, str], int] = {}
        start: dict[tuple[int, str], int] = {}
        held: list[list[tuple[int, str]]] = []
        end = None
        for k, (s, e, label) in enumerate(nodes):
            i = first + k
            token = text[s:e]
            self.feature.append(features(token))
            self.label.append(label)
            beside = end is not None and 0 < s - end <= 2 and text[end:s].isspace()
            self.plain.append((0 if beside else 1) + 1)
            if beside:
                self.edges.append((i - 1, i, 0))
                self.plain[i - 1] -= 1
            held.append(keys(token))
            for key in held[-1]:
                start.setdefault(key, i)
                if label >= 0:
                    seen.setdefault(key, i)
            end = e
        for i, own in enumerate(held, first):
            key = next((key for key in own if key in seen), own[-1] if own else None)
            if key is not None:
                hub = seen.get(key, start[key])
                if hub != i and self.label[i] < 0:
                    self.edges.append((hub, i, key[0] + 1))
        return first


def marginals(g: Graph, weights: dict[str, np.ndarray], rounds: int = ROUNDS) -> np.ndarray:
    """Loopy sum-product over every component at once; observed nodes are clamped."""
    n = len(g.label)
    label = np.array(g.label)
    unary = np.array(g.feature, dtype=float).reshape(n, FEATURES) @ weights["node"]
    unary += np.array(g.plain, dtype=float)[:, None] * weights["plain"][None, :]
    seen = label >= 0
    unary[seen] = -1e9  # beyond what any number of neighbours can say
    unary[seen, label[seen]] = 0.0
    if not g.edges:
        b = np.exp(unary - unary.max(1, keepdims=True))
        return b / b.sum(1, keepdims=True)
    e = np.array(g.edges)
    src = np.concatenate([e[:, 0], e[:, 1]])
    dst = np.concatenate([e[:, 1], e[:, 0]])
    m = len(e)
    back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
    pair = np.empty((2 * m, LABELS, LABELS))
    kind = e[:, 2]
    chain = kind == 0
    pair[:m][chain] = np.exp(weights["chain"])
    pair[m:][chain] = np.exp(weights["chain"].T)
    same = np.exp(weights["skip"][np.maximum(kind - 1, 0)][:, None, None] * np.eye(LABELS)[None])
    pair[:m][~chain] = same[~chain]
    pair[m:][~chain] = same[~chain]
    message = np.full((2 * m, LABELS), 1.0 / LABELS)
    for _ in range(rounds):
        total = unary.copy()
        np.add.at(total, dst, np.log(message))
        out = total[src] - np.log(message[back])
        out = np.exp(out - out.max(1, keepdims=True))
        new = np.einsum("ea,eab->eb", out, pair)
        new = new / new.sum(1, keepdims=True) + 1e-12
        step = np.abs(new - message).max()
        message = 0.3 * message + 0.7 * new
        if step < SETTLED:
            break
    total = unary.copy()
    np.add.at(total, dst, np.log(message))
    b = np.exp(total - total.max(1, keepdims=True))
    return b / b.sum(1, keepdims=True)


def _sentence(r: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """A generated document and (start, end, label) of what patterns miss: entities by their kind, decoys as 0."""
    digit = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 8)))
    area, mid, tail = str(r.randint(2, 9)) + digit(2), digit(3), digit(4)
    octets = [str(r.randint(0, 255)) for _ in range(4)]
    card = digit(15)
    card += next(d for d in "0123456789" if luhn(card + d))
    four = [card[i : i + 4] for i in (0, 4, 8, 12)]
    name, host = word() + digit(r.choice([0, 2])), word() + "." + word() + ".com"
    ten = area + mid + tail
    pairs = " ".join(ten[k : k + 2] for k in range(0, 10, 2))
    code = r.choice(["1", "44", "33", "7"])
    full = [
        r.choice([f"+{code} ({area}) {mid}-{tail}", f"+{code}-{area}-{mid}-{tail}", f"+{code} {area} {mid} {tail}", f"+{code}{ten}"]),
        ".".join(octets), r.choice([card, " ".join(four), "-".join(four)]), f"{name}@{host}",
    ]
    in_pairs = r.random() < 0.15
    if in_pairs:
        full[0] = f"+33 {pairs[1:]}"
    hurt = [
        ("0" + pairs[1:] if in_pairs else r.choice([f"({area}) {mid}-{tail}", f"{area}-{mid}-{tail}", ten, f"{area} {mid} {tail}", f"{area}.{mid}.{tail}", f"00{code} {area} {mid} {tail}", f"({area}){mid}-{tail}", f"{code}-{area}-{mid}-{tail}"]), 4),
        (r.choice(["[.]", "-", "(.)", "[dot]", "_", "[.]"]).join(octets), 2),
        (r.choice([".", "/", "_", "  "]).join(four), 3),
        (r.choice(["[at]", "(at)", "[AT]"]).join((name, r.choice([host, host.replace(".", "[dot]")]))), 1),
    ]
    noise = [
        digit(r.choice([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 16, 16, 20])), f"{digit(3)}-{digit(3)}", f"{digit(2)}.{digit(3)}.{digit(1)}", word() + digit(4), f"({digit(4)})", f"{digit(3)},{digit(3)}",
        f"20{digit(2)}-{digit(2)}-{digit(2)}", f"{digit(2)}.{digit(2)}.20{digit(2)}", f"{digit(1)}.{digit(1)}.{digit(2)}", f"{digit(3)}-{digit(3)}-{digit(4)}", "".join(r.choice("0123456789abcdef") for _ in range(r.choice([8, 40]))),
        f"{digit(2)} {digit(2)}", f"{digit(4)}-{digit(4)}", f"{digit(1)}:{digit(2)}",
    ]
    pieces: list[tuple[str, int]] = []
    for k in range(4):
        if r.random() < 0.5:
            pieces.append((full[k], -1))
            if r.random() < 0.7:
                pieces += [hurt[k]] * r.randint(1, 2)
        elif r.random() < 0.15:
            pieces.append((hurt[k][0], 0))
    pieces += [(x, 0) for x in r.sample(noise, r.randint(1, 6))]
    repeat = digit(r.choice([5, 7, 10]))
    pieces += [(repeat, 0)] * r.randint(0, 2)
    r.shuffle(pieces)
    text, truth = "", []

    def put(piece: str, label: int) -> None:
        nonlocal text
        truth.append((len(text), len(text) + len(piece), label))
        text += piece

    for piece, label in pieces:
        text += " ".join(word() for _ in range(r.randint(0 if r.random() < 0.1 else 1, 4))) + " "
        put(piece, label)
        text += r.choice([" ", " ", " ", ". ", ", ", "\n"])
    if r.random() < 0.1:  # a number that runs into the next one, which the patterns give up
        text += word() + " "
        put(f"+{code} ({digit(3)}) {digit(3)}-{digit(4)}", 4)
        text += " " + ".".join(str(r.randint(11, 255)) for _ in range(4)) + " " + word()
    return text, truth


def train(sentences: int = TRAINING_SENTENCES, seed: int = 7) -> dict[str, np.ndarray]:
    """Fit all weights by pseudo-likelihood: each node given the true labels beside it."""
    r = random.Random(seed)
    g, gold = Graph(), []
    for _ in range(sentences):
        text, truth = _sentence(r)
        nodes = tokens(text, base_spans(text))
        g.add(text, nodes)
        gold += [label if label >= 0 else max(next((x for a, b, x in truth if a <= s < b), 0), 0) for s, _, label in nodes]
    y, label = np.array(gold), np.array(g.label)
    n = len(y)
    x = np.array(g.feature, dtype=float)
    plain = np.array(g.plain, dtype=float)
    left, right, skip = np.zeros((n, LABELS)), np.zeros((n, LABELS)), np.zeros((SKIPS, n, LABELS))
    for i, j, kind in g.edges:
        if kind == 0:
            left[j, y[i]] += 1
            right[i, y[j]] += 1
        else:
            skip[kind - 1, i, y[j]] += 1
            skip[kind - 1, j, y[i]] += 1
    free = label < 0
    w = {"node": np.zeros((FEATURES, LABELS)), "plain": np.zeros(LABELS), "chain": np.zeros((LABELS, LABELS)), "skip": np.zeros(SKIPS)}
    speed = {k: np.zeros_like(v) for k, v in w.items()}
    target = np.eye(LABELS)[y]
    for _ in range(300):
        score = x @ w["node"] + plain[:, None] * w["plain"] + left @ w["chain"] + right @ w["chain"].T + np.einsum("k,kna->na", w["skip"], skip)
        p = np.exp(score - score.max(1, keepdims=True))
        d = (target - p / p.sum(1, keepdims=True)) * free[:, None] / free.sum()
        step = {"node": x.T @ d, "plain": plain @ d, "chain": left.T @ d + d.T @ right, "skip": np.einsum("na,kna->k", d, skip)}
        for k in w:
            speed[k] = 0.9 * speed[k] + step[k] - 1e-4 * w[k]
            w[k] = w[k] + 0.5 * speed[k]
    return w


weights = once(train)


def added_spans(graph: Graph, belief: np.ndarray, first: int, nodes: list[tuple[int, int, int]], text: str) -> list[tuple[int, int, int]]:
    """Spans of the field's own labels; touching tokens of one label join."""
    out: list[tuple[int, int, int]] = []
    for k, (s, e, label) in enumerate(nodes):
        if label >= 0:
            continue
        best = int(belief[first + k].argmax())
        if best == 0 or belief[first + k, best] < SURE:
            continue
        if out and out[-1][1] == best - 1 and s - out[-1][2] <= 2 and text[out[-1][2] : s].isspace() and nodes[k - 1][2] < 0:
            out[-1] = (out[-1][0], best - 1, e)
        else:
            out.append((s, best - 1, e))
    return out


def find(batch: list[str], w: dict[str, np.ndarray]) -> list[tuple[list, list]]:
    """(base spans, added spans) of each text."""
    g, held, out = Graph(), [], []
    for k, text in enumerate(batch):
        base = base_spans(text)
        out.append((base, []))
        if HINT.search(text):
            nodes = tokens(text, base)
            if any(label < 0 for _, _, label in nodes):
                held.append((k, g.add(text, nodes), nodes))
    if held:
        belief = marginals(g, w)
        for k, first, nodes in held:
            out[k] = (out[k][0], added_spans(g, belief, first, nodes, batch[k]))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def spans_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id and all spans, each with its kind, place and whether it is a base span."""
    w = weights()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                ids, text = (c.to_pylist() for c in whole.slice(lo, 256).columns)
                found = find([t or "" for t in text], w)
                rows = [[{"kind": KINDS[k], "start": s, "stop": e, "base": b} for s, k, e, b in sorted([(*x, True) for x in base] + [(*x, False) for x in more])] for base, more in found]
                yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(rows, span_type)], names=["id", "spans"])

    id_type = pa.int64() if dict(df.dtypes)[id_col] == "bigint" else pa.string()
    span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("base", pa.bool_())]))
    kind = "bigint" if id_type == pa.int64() else "string"
    picked = df.select(F.col(id_col).cast(kind).alias("id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, f"id {kind}, {SPAN_COLUMNS}").withColumnRenamed("id", id_col)


def report(df: DataFrame) -> DataFrame:
    """``spans_of`` as counts of base spans, a digest of them, and all spans as text."""
    w = weights()
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                ids, text = (c.to_pylist() for c in whole.slice(lo, 256).columns)
                found = find([t or "" for t in text], w)
                counts = [[sum(k == kind for _, k, _ in base) for base, _ in found] for kind in range(4)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()),
                        *(pa.array(c, pa.int64()) for c in counts),
                        pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found]),
                        pa.array([joined(base + more) for base, more in found]),
                        pa.array([len(more) for _, more in found], pa.int64()),
                    ],
                    names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"],
                )

    return df.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Every span of ``text_col`` replaced by ``<KIND>``; other columns pass unchanged, null texts stay null.

    Overlapping spans become one replacement under the kind that starts first.
    """
    w = weights()
    at = df.columns.index(text_col)

    def cleaned(text: str, spans: list[tuple[int, int, int]]) -> str:
        parts, done = [], 0
        for s, k, e in sorted(spans):
            if s >= done:
                parts += [text[done:s], f"<{KINDS[k].upper()}>"]
            done = max(done, e)
        return "".join([*parts, text[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                part = whole.slice(lo, 256)
                text = part.column(at).to_pylist()
                found = find([t or "" for t in text], w)
                new = [None if t is None else cleaned(t, base + more) for t, (base, more) in zip(text, found)]
                columns = list(part.columns)
                columns[at] = pa.array(new, part.schema.field(at).type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return df.mapInArrow(run, df.schema)
