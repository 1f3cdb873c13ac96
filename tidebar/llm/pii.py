"""Personal data: fixed patterns and a skip-chain conditional random field (operator 6)."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sliced, table

LABELS = ("email", "ip", "card", "phone")
#: Coupling of a skip edge, posterior from which a span counts, least length of a key that leaves out a token's marks.
SKIP, SURE, KEY = 6.0, 0.9, 6
#: Message passing ends when no message changes by more than CLOSE; at the latest after ROUNDS rounds and one for each
#: token of the longest group of equal keys.
ROUNDS, CLOSE = 100, 1e-4
#: Edges whose messages are worked out together.
EDGES = 1 << 15

# The contract's patterns, anchored where that saves retries without changing any match.
_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")
_NODE = re.compile(r"\+?[0-9][0-9().\x20-]{4,}[0-9]|(?<![A-Za-z0-9._%+@-])[A-Za-z0-9._%+@-]*[A-Za-z0-9][.@_+%-][A-Za-z0-9][A-Za-z0-9._%+@-]*|(?<![A-Za-z0-9])[A-Za-z]*[0-9][A-Za-z0-9]*")
_HINT = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns in the whole text, sorted; code points, end exclusive."""
    out: list[tuple[int, int, int]] = []
    at, done = text.find("@"), 0
    while at >= 0:
        s = at
        while s > done and text[s - 1] in _LOCAL:
            s -= 1
        m = _AT.match(text, at) if s < at else None
        if m:
            out.append((s, 0, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if _HINT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            d = _DIGITS.sub("", m[0])
            if 14 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 10 <= len(_DIGITS.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def nodes(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, label) of base spans (1 + kind; where they overlap, the first) and, between them, of tokens with
    digits or joining marks (label 0, to be inferred)."""
    out, edge = [], 0
    for s, kind, e in [*base, (len(text), -1, len(text))]:
        if s < edge:
            continue
        out += [(m.start(), m.end(), 0) for m in _NODE.finditer(text, edge, s)]
        if kind >= 0:
            out.append((s, e, kind + 1))
        edge = e
    return out


def shape(token: str) -> str:
    digits = sum(c.isdigit() for c in token)
    return f"{min(digits, 20)}{'@' if '@' in token else ''}{'+' if token[0] == '+' else ''}{'.' * min(3, token.count('.'))}{'a' if any(c.isalpha() for c in token) else ''}"


def keys(token: str) -> list[str]:
    """What makes distant tokens the same or similar: nine last digits of a number, or the letters and digits, or an
    address's name. Where these are few (short IPs and addresses), the places of the marks between them count too."""
    digits = _DIGITS.sub("", token)
    if len(digits) >= 7 and not any(c.isalpha() for c in token):
        return ["#" + digits[-9:]]
    name, mark, _ = token.lower().partition("@")
    core = [re.findall(r"[a-z0-9]+", x) for x in ([token.lower(), name] if mark else [token.lower()])]
    return list(dict.fromkeys("".join(c) if sum(map(len, c)) >= KEY else "=" + ".".join(c) for c in core if c))


def skip_edges(groups, labels) -> list[tuple[int, int]]:
    """Skip edges of groups of tokens (in order, by place): each token with the next, and every token with the group's
    centres, which are the first token of each label (of 0, none is known). A group without a label has one centre, the
    first token that a group with one holds too, else its first. So labels are two edges away at most, and edges grow as tokens."""
    groups = [g for g in groups if len(g) > 1]
    told = {i for g in groups if any(labels[i] for i in g) for i in g}
    out = {}
    for g in groups:
        first: dict[int, int] = {}
        for i in g:
            if labels[i]:
                first.setdefault(labels[i], i)
        centres = list(first.values()) or [next((i for i in g if i in told), g[0])]
        out.update(dict.fromkeys(zip(g, g[1:])))
        # Two known labels tell each other nothing.
        out.update(dict.fromkeys((min(c, i), max(c, i)) for c in centres for i in g if i != c and not (labels[c] and labels[i])))
    return list(out)


def learn(docs: DataFrame) -> dict:
    """Log-potentials counted over every document: label by token shape, and label after label within a document.

    Base spans label their tokens, all others are `none`. Spark sums the counts; the driver sees a few hundred shapes."""

    def count(batches):
        sums: dict[tuple[str, int], int] = {}
        for b in sliced(batches):
            for text in b.column(0).to_pylist():
                if not text or not _HINT.search(text):
                    continue
                last = 0
                for s, e, label in nodes(text, base_spans(text)):
                    for k in ((f"u{shape(text[s:e])}", label), (f"c{last}", label)):
                        sums[k] = sums.get(k, 0) + 1
                    last = label
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.int32()), pa.array(list(sums.values()), pa.int64())], ["what", "label", "n"])

    rows = docs.select("text").mapInArrow(count, "what string, label int, n long").groupBy("what", "label").agg(F.sum("n").alias("n")).collect()
    tables: dict[str, np.ndarray] = {}
    for r in rows:
        tables.setdefault(r.what, np.full(5, 0.5))[r.label] += r.n
    return {k: np.log(v / v.sum()) for k, v in tables.items()}


def marginals(unary: np.ndarray, chain: np.ndarray, skip: list[tuple[int, int]], rounds: int) -> np.ndarray:
    """Label probabilities of the nodes of a chain with skip edges, whose ends like to be alike, by loopy message passing
    until the messages settle: exact where the edges make no loop. Work space is of EDGES edges, whatever the text."""
    n, k = len(unary), len(skip)
    pots = np.stack([chain, chain.T, np.eye(unary.shape[1]) * SKIP])
    kind = np.repeat([0, 1, 2], [n - 1, n - 1, 2 * k])
    src = np.array([*range(n - 1), *range(1, n), *(a for a, _ in skip), *(b for _, b in skip)], int)
    dst = np.array([*range(1, n), *range(n - 1), *(b for _, b in skip), *(a for a, _ in skip)], int)
    back = np.concatenate([np.arange(n - 1, 2 * n - 2), np.arange(n - 1), np.arange(2 * n - 2 + k, 2 * n - 2 + 2 * k), np.arange(2 * n - 2, 2 * n - 2 + k)])
    msg, new = np.zeros((len(src), unary.shape[1])), np.zeros((len(src), unary.shape[1]))
    for _ in range(rounds):
        belief = unary.copy()
        np.add.at(belief, dst, msg)
        for a in range(0, len(src), EDGES):
            at = slice(a, a + EDGES)
            out = (belief[src[at]] - msg[back[at]])[:, :, None] + pots[kind[at]]
            top = out.max(axis=1, keepdims=True)
            new[at] = top[:, 0] + np.log(np.exp(out - top).sum(axis=1))
        step = 0.5 * (new - new.max(axis=1, keepdims=True) - msg)
        msg += step
        if not len(step) or np.abs(step).max() < CLOSE:
            break
    belief = unary.copy()
    np.add.at(belief, dst, msg)
    post = np.exp(belief - belief.max(axis=1, keepdims=True))
    return post / post.sum(axis=1, keepdims=True)


def infer(text: str, base: list[tuple[int, int, int]], model: dict) -> list[tuple[int, int, int]]:
    """Spans (start, kind, end) that message passing adds to base: tokens linked to others by a skip edge whose posterior
    for one label is SURE or more. Messages pass until they settle, so a label reaches every token of its key."""
    own = nodes(text, base)
    if not any(label for *_, label in own) or all(label for *_, label in own):
        return []
    groups: dict[str, list[int]] = {}
    for i, (s, e, _) in enumerate(own):
        for k in keys(text[s:e]):
            groups.setdefault(k, []).append(i)
    skip = skip_edges(groups.values(), [label for *_, label in own])
    if not skip:
        return []
    flat = np.log(np.full(5, 0.2))
    unary = np.array([model.get("u" + shape(text[s:e]), flat) * 0.25 for s, e, _ in own])
    for i, (*_, label) in enumerate(own):
        if label:
            unary[i] = -1e6  # beyond what the messages of any number of tokens add up to
            unary[i, label] = 0.0
    chain = np.array([model.get(f"c{i}", flat) for i in range(5)]) * 0.25
    post = marginals(unary, chain, skip, ROUNDS + max(map(len, groups.values())))
    linked = {i for pair in skip for i in pair}
    return [(s, int(post[i].argmax()) - 1, e) for i, (s, e, label) in enumerate(own) if not label and i in linked and post[i, 0] < 0.5 and post[i].max() >= SURE]


def span_text(spans) -> str:
    return ",".join(f"{LABELS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def find(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every whole text; null text is empty.

    Repeated rows and equal doc_ids give a row each, an empty table none, other columns are not read."""
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]

    def run(batches):
        for b in sliced(batches):
            got = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                text = text or ""
                base = base_spans(text)
                more = infer(text, base, model) if base else []
                n = [0, 0, 0, 0]
                for _, k, _ in base:
                    n[k] += 1
                got.append((doc_id, *n, hashlib.sha256(span_text(base).encode()).hexdigest(), span_text([*base, *more])))
            types = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], t) for i, t in enumerate(types)], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def op6_pii_skip_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`find` for every document with potentials counted over all of them; odd rows as there."""
    docs = table(spark, sf_dir, "documents")
    return find(docs, learn(docs))
