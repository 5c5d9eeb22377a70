"""Personal data: exact base rules, completed by a skip-chain conditional random field.

Base spans (email, ip, card, phone) are found by fixed patterns and are always
kept. The CRF looks at what the patterns miss: number groups of 7 to 19 digits
and words around an at sign that no base span covers, and repeats of an email's
local part. Its nodes are the base spans (their labels are observed) and these
loose candidates. Neighbouring nodes share chain potentials; nodes with a common
key (the same digits, the same last ten digits, the same local part), however
far apart, share skip potentials. Loopy belief propagation spreads the observed
labels; a loose node whose belief in one kind reaches THRESHOLD becomes a span
of that kind.

The potentials are logs of rates over all documents, mixed with a fixed share of
prior, so they do not change with the size of the corpus. Base spans count with
their kind and loose candidates, being unlabelled rather than negative, as "none"
with the weight UNLABELLED; how often nodes of one key agree is counted on
observed ones only. Nodes with one key are linked in a row, first to second to
third, and each to the key's first base span, so edges grow with the nodes, not
their square, and a span's label is one step away from all its repeats.

Results for odd input: a null or empty text has no spans; repeated rows give
repeated rows; an empty table gives an empty table; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, table

KINDS = ("email", "ip", "card", "phone")
NONE = len(KINDS)
#: Belief that turns a loose candidate into a span.
THRESHOLD = 0.6
UNLABELLED = 0.2
#: Share of the prior in a rate, and what nodes of one key agree in by the prior.
PRIOR, AGREEMENT = 0.4, 0.95
#: Bounds of a potential's absolute value: of skip edges, of chain edges.
BOUND, CHAIN_BOUND = 4.0, 0.25
#: Edges whose messages are computed at once.
EDGES = 1 << 16
#: Neighbours further apart than this many characters share no chain potential.
NEAR = 200
ROUNDS, DAMPING, SETTLED = 30, 0.5, 1e-4

# The domain finds an email; its local part is what stands before, back to the last match.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_ANY = re.compile(r"[0-9@]")
_LOOSE = re.compile(r"(?<![\w@.+-])\+?\(?[0-9](?:[ ().-]{0,2}[0-9])+(?![\w@])")
_AT = re.compile(r"\S*@\S*")
_WORD = re.compile(r"[A-Za-z0-9._%+-]{4,}")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free = 0
    for m in _DOMAIN.finditer(text):
        start = at = m.start()
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            yield start, m.end()
            free = m.end()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by start, then kind; code points, end exclusive."""
    out = []
    if "@" in text:
        out += [(s, 0, e) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if 14 <= m.end() - m.start():
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(map(len, _DIGITS.findall(m[0]))) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _shape(word: str) -> str:
    """What the unary potential sees: the grouping of digits, not the marks that the base rules ask for; a failed Luhn sum, as no repeat mends it."""
    if "@" in word:
        return "at:" + ("dot" if "." in word.rpartition("@")[2] else "bare")
    digits = _DIGITS.findall(word)
    groups = [len(g) for g in digits]
    if not groups or re.search(r"[A-Za-z]", word):
        return "handle"
    n = sum(groups)
    tail = "-".join(str(min(g, 9)) for g in groups[-3:])
    luhn = "" if not 14 <= n <= 19 else ":sum" if _luhn("".join(digits)) else ":off"
    return f"n{min(n, 20)}:{min(len(groups), 5)}:{tail}{luhn}"


def _keys(word: str) -> list[str]:
    """What makes two nodes similar: the digits in full and their last ten, or an email's local part."""
    if "@" in word or re.search(r"[A-Za-z]", word):
        local = word.partition("@")[0].strip("<>()[]{}\"',;:").lower()
        return ["h" + local] if local else []
    digits = "".join(_DIGITS.findall(word))
    return ["d" + digits] + (["t" + digits[-10:]] if len(digits) > 10 else ["t" + digits] if len(digits) == 10 else [])


def nodes_of(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, str, list[str]]]:
    """(start, end, kind or NONE, shape, keys) of base spans and loose candidates, by start."""
    nodes = [(s, e, k, _shape(text[s:e]), _keys(text[s:e])) for s, k, e in base]
    taken = sorted((s, e) for s, _, e in base)
    ends = np.maximum.accumulate([e for _, e in taken]) if taken else []
    starts = [s for s, _ in taken]

    def free(s: int, e: int) -> bool:
        i = int(np.searchsorted(starts, e)) - 1
        return i < 0 or ends[i] <= s

    found = [(m.start(), m.end()) for m in _LOOSE.finditer(text) if m.end() - m.start() >= 7 and 7 <= sum(map(len, _DIGITS.findall(m[0]))) <= 19]
    if "@" in text:
        found += [(m.start(), m.end()) for m in _AT.finditer(text) if m.end() - m.start() > 1]
    handles = {n[4][0][1:] for n in nodes if n[2] == 0 and n[4]}
    if handles := {h for h in handles if re.search(r"[0-9._%+-]", h)}:
        found += [(m.start(), m.end()) for m in _WORD.finditer(text) if m[0].lower() in handles]
    last = -1
    for s, e in sorted(found):
        if s >= last and free(s, e):
            nodes.append((s, e, NONE, _shape(text[s:e]), _keys(text[s:e])))
            last = e
    return sorted(nodes, key=lambda n: n[:3])


def edges_of(nodes: list) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain edges between neighbours; skip edges along the occurrences of each key and to its first base span."""
    chain = [(i, i + 1) for i in range(len(nodes) - 1) if nodes[i + 1][0] - nodes[i][1] <= NEAR]
    seen: dict[str, int] = {}
    observed: dict[str, int] = {}
    for i, n in enumerate(nodes):
        if n[2] != NONE:
            for key in n[4]:
                observed.setdefault(key, i)
    skip = set()
    for i, n in enumerate(nodes):
        for key in n[4]:
            if key in seen:
                skip.add((seen[key], i))
            if (j := observed.get(key, i)) != i:
                skip.add((min(i, j), max(i, j)))
            seen[key] = i
    return chain, sorted(skip)


def _counts(nodes: list) -> Counter:
    """Weighted counts for the potentials: (what, x, y)."""
    weight = [UNLABELLED if n[2] == NONE else 1.0 for n in nodes]
    out: Counter = Counter()
    for n, w in zip(nodes, weight, strict=True):
        out["unary", n[3], n[2]] += w
    chain, skip = edges_of(nodes)
    for i, j in chain:
        out["chain", str(nodes[i][2]), nodes[j][2]] += min(weight[i], weight[j])
    for i, j in skip:
        if nodes[i][2] != NONE != nodes[j][2]:
            out["skip", str(nodes[i][2]), nodes[j][2]] += 1.0
    return out


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    node = pa.struct([("s", pa.int32()), ("e", pa.int32()), ("k", pa.int32()), ("shape", pa.string()), ("keys", pa.list_(pa.string()))])
    count = pa.struct([("what", pa.string()), ("x", pa.string()), ("y", pa.int32()), ("n", pa.float64())])
    for batch in batches:
        bases, nodes, counts = [], [], []
        for t in batch.column(1):
            text = t.as_py() or ""
            base = base_spans(text) if _ANY.search(text) else []
            found = nodes_of(text, base) if base or _ANY.search(text) else []
            bases.append([{"s": s, "k": k, "e": e} for s, k, e in base])
            # Without loose candidates there is nothing to infer, and only the counts matter.
            nodes.append([dict(zip(("s", "e", "k", "shape", "keys"), n, strict=True)) for n in found] if any(n[2] == NONE for n in found) else [])
            counts.append([{"what": w, "x": x, "y": y, "n": n} for (w, x, y), n in _counts(found).items()])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(bases, pa.list_(pa.struct([("s", pa.int32()), ("k", pa.int32()), ("e", pa.int32())]))), pa.array(nodes, pa.list_(node)), pa.array(counts, pa.list_(count))],
            ["doc_id", "base", "nodes", "counts"],
        )


SCANNED = "doc_id long, base array<struct<s:int,k:int,e:int>>, nodes array<struct<s:int,e:int,k:int,shape:string,keys:array<string>>>, counts array<struct<what:string,x:string,y:int,n:double>>"


class Potentials:
    """Log potentials over the labels (the kinds, then none), from weighted counts."""

    def __init__(self, counts: list[tuple[str, str, int, float]]):
        labels = NONE + 1
        unary: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(labels))
        pairs = {w: np.zeros((labels, labels)) for w in ("chain", "skip")}
        for what, x, y, n in counts:
            if what == "unary":
                unary[x][y] += n
            else:
                pairs[what][int(x), y] += n
        mixed = lambda v, prior: prior if v.sum() == 0 else (1 - PRIOR) * v / v.sum() + PRIOR * prior
        even = np.full(labels, 1 / labels)
        self.unary = {k: np.log(mixed(v, even)) for k, v in unary.items()}
        self.unseen = np.log(even)
        p = mixed(pairs["chain"] + pairs["chain"].T, np.full((labels, labels), 1 / labels**2))
        chain = np.clip(np.log(p / np.outer(p.sum(1), p.sum(0))), -CHAIN_BOUND, CHAIN_BOUND)
        # Agreement of each kind with what it shares a key with, against any one other label.
        both = pairs["skip"] + pairs["skip"].T
        agree = np.array([mixed(np.array([both[k, k], both[k].sum() - both[k, k]]), np.array([AGREEMENT, 1 - AGREEMENT]))[0] for k in range(labels)])
        skip = np.diag(np.clip(np.log(agree * (labels - 1) / (1 - agree)), 0, BOUND))
        self.pair = {"chain": chain, "skip": skip}


def beliefs(nodes: list, potentials: Potentials) -> np.ndarray:
    """Marginals of each node by loopy belief propagation; base nodes are clamped to their kind."""
    unary = np.array([potentials.unary.get(n[3], potentials.unseen) for n in nodes])
    for i, n in enumerate(nodes):
        if n[2] != NONE:
            unary[i] = -1e3
            unary[i, n[2]] = 0
    chain, skip = edges_of(nodes)
    edges = np.array([*chain, *skip], dtype=np.int64).reshape(-1, 2)
    kinds = np.array([0] * len(chain) + [1] * len(skip))
    # Both matrices are symmetric, so a message back goes through the same one.
    pair = np.stack([potentials.pair["chain"], potentials.pair["skip"]])
    # Messages go both ways: row e is from edges[e, 0] to edges[e, 1], row e + len(edges) back.
    source, target, kinds = np.r_[edges[:, 0], edges[:, 1]], np.r_[edges[:, 1], edges[:, 0]], np.r_[kinds, kinds].astype(np.int64)
    back = np.r_[np.arange(len(edges)) + len(edges), np.arange(len(edges))]
    messages = np.zeros((len(source), NONE + 1))
    for _ in range(ROUNDS):
        total = unary.copy()
        np.add.at(total, target, messages)
        sent = total[source] - messages[back]
        out = np.empty_like(messages)
        for i in range(0, len(source), EDGES):
            part = slice(i, i + EDGES)
            out[part] = np.logaddexp.reduce(sent[part][:, :, None] + pair[kinds[part]], axis=1)
        out -= np.logaddexp.reduce(out, axis=1)[:, None]
        step = (1 - DAMPING) * (out - messages)
        messages = messages + step
        if not len(step) or np.abs(step).max() < SETTLED:
            break
    total = unary.copy()
    np.add.at(total, target, messages)
    return np.exp(total - np.logaddexp.reduce(total, axis=1)[:, None])


def _said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def _infer_batches(potentials: Potentials):
    def infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for b, n in zip(batch.column(1), batch.column(2), strict=True):
                base = [(x["s"], x["k"], x["e"]) for x in b.as_py()]
                nodes = [(x["s"], x["e"], x["k"], x["shape"], x["keys"]) for x in n.as_py()]
                added = _added(nodes, potentials) if nodes else []
                per = Counter(k for _, k, _ in base)
                rows.append([*(per[k] for k in range(NONE)), hashlib.sha256(_said(base).encode()).hexdigest(), _said(base + added), len(added)])
            cols = list(zip(*rows, strict=True)) if rows else [[]] * (NONE + 3)
            kinds = [pa.int64()] * NONE + [pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True))], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    return infer


def _added(nodes: list, potentials: Potentials) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the loose candidates that inference takes for personal data."""
    p = beliefs(nodes, potentials)
    return [(x[0], int(k), x[1]) for x, k, q in zip(nodes, p.argmax(axis=1), p.max(axis=1), strict=True) if x[2] == NONE and k != NONE and q >= THRESHOLD]


def _fit(scanned: DataFrame) -> Potentials:
    counts = scanned.select(F.explode("counts").alias("c")).groupBy("c.what", "c.x", "c.y").agg(F.sum("c.n").alias("n"))
    # Shapes and labels are finitely many: at most a few thousand rows, however many documents.
    return Potentials([tuple(r) for r in counts.collect()])


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all), n_added."""
    scanned = materialize(docs.select("doc_id", "text").mapInArrow(_scan_batches, SCANNED), "pii")
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return scanned.select("doc_id", "base", "nodes").mapInArrow(_infer_batches(_fit(scanned)), schema)


def redact(text: str, found: list[tuple[int, int, int]]) -> str:
    """text with each span replaced by its kind in angle brackets; of overlapping spans the first names the place."""
    out, last = [], 0
    for s, k, e in sorted(found):
        if s >= last:
            out += [text[last:s], f"<{KINDS[k]}>"]
        last = max(last, e)
    return "".join(out) + text[last:]


def redacted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): the texts with all spans of ``spans`` replaced; null stays null."""
    rows = docs.select("doc_id", "text")
    potentials = _fit(rows.mapInArrow(_scan_batches, SCANNED))

    def batches_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for t in batch.column(1):
                if (text := t.as_py()) and _ANY.search(text):
                    base = base_spans(text)
                    nodes = nodes_of(text, base)
                    text = redact(text, base + (_added(nodes, potentials) if nodes else []))
                texts.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.mapInArrow(batches_out, "doc_id long, text string")


def op2_pii_skip_chain(spark, sf_dir: str) -> DataFrame:
    return spans(table(spark, sf_dir, "documents"))
