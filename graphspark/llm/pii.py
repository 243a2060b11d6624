"""Personal data: patterns, and a skip-chain conditional random field that carries labels to repeated or similar tokens."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import saved

#: Kinds in their fixed order; label 0 is none.
KINDS = ("email", "ip", "card", "phone")
LABELS = 1 + len(KINDS)
#: The model is fitted on at most so many documents that have candidate tokens, those of the smallest hash of their id.
FIT_DOCS = 3000
#: And on as many of them as have so many tokens together; these are what the driver gets.
FIT_TOKENS = 200_000
#: A label is given to a token when its marginal probability is at least so much.
CONFIDENT = 0.9
#: Messages are passed until none changes by more than SETTLED, and so many rounds at most, in which a label crosses as many edges.
ROUNDS, SETTLED = 200, 1e-4
DAMPING = 0.3
#: Tokens of which a similar one is looked for: digits in a row without separators, or the letters of an address.
_EMAIL_END = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")  # in linear time: digits are never given back
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_RUN = re.compile(r"\S+")
_DIGIT = re.compile(r"[0-9]")
_WORD_BEFORE = re.compile(r"([^\W\d_]+)[\W_]*$")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in _EMAIL_LOCAL:
            begin -= 1
        m = _EMAIL_END.match(text, at + 1) if begin < at else None
        if m:
            out.append((begin, m.end()))
            last = m.end()
            at = text.find("@", last)
        else:
            at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of what the patterns find, by start and kind; leftmost matches of a kind do not overlap."""
    found = [(a, z, "email") for a, z in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        found += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(len(p) <= 3 and int(p or "0") <= 255 for p in (q.lstrip("0") for q in m[0].split(".")))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


@dataclass
class Token:
    start: int
    end: int
    label: int  # what the patterns say; 0 where they say nothing
    before: str


def tokens(text: str, spans: list[tuple[int, int, str]]) -> list[Token]:
    """The base spans (a longer one hides what it covers), and between them the words that hold a digit or an @."""
    out, reach = [], 0
    for a, z, kind in spans:
        if a >= reach:
            out.append(Token(a, z, 1 + KINDS.index(kind), ""))
            reach = z
    low = 0
    for high, after in [*((t.start, t.end) for t in out), (len(text), len(text))]:
        for m in _RUN.finditer(text, low, high):
            if "@" not in m[0] and not _DIGIT.search(m[0]):
                continue
            a, z = m.start(), m.end()
            while a < z and not (text[a].isalnum() or text[a] in "+("):
                a += 1
            while z > a and not text[z - 1].isalnum():
                z -= 1
            if a < z:
                out.append(Token(a, z, 0, ""))
        low = after
    out.sort(key=lambda t: t.start)
    for t in out:
        w = _WORD_BEFORE.search(text, max(0, t.start - 40), t.start)
        t.before = w[1].lower() if w else ""
    return out


#: Features of a token; none of them is the patterns' own test.
FEATURES = 1 + 8 + 6 + 4 + 5 + 64


def features(text: str, t: Token) -> np.ndarray:
    """Indices of the token's features: length of its digits, separators, letters, neighbours and the word before."""
    s = text[t.start : t.end]
    digits = sum(c in "0123456789" for c in s)
    letters = sum(c.isalpha() for c in s)
    f = [0, 1 + min(7, digits // 3)]
    f += [9 + i for i, c in enumerate(". -()@") if c in s][:6]
    f.append(15 + min(3, s.count(".")))
    f.append(19 + (0 if not letters else 1 if not digits else 2 if letters < digits else 3))
    if t.start and text[t.start - 1] == "+" or s[:1] == "+":
        f.append(23)
    if t.before:
        f.append(24 + sum(map(ord, t.before)) % 64)
    return np.array(sorted(set(f)))


def keys(text: str, t: Token) -> list[str]:
    """What distant tokens share: all digits, the digits without a country code, the letters and marks of an address."""
    s = text[t.start : t.end]
    digits = "".join(c for c in s if c in "0123456789")
    if "@" in s or any(c.isalpha() for c in s):
        # an address and its local part are similar; so are spellings that differ in marks
        local = s.split("@")[0]
        return ["a:" + s.lower(), "l:" + re.sub(r"[^a-z0-9]", "", local.lower())]
    return ["a:" + s.lower(), *(["d:" + digits, "e:" + digits[-10:]] if len(digits) >= 7 else [])]


@dataclass
class Field:
    weights: np.ndarray  # (FEATURES, LABELS)
    chain: np.ndarray  # (LABELS, LABELS) log potentials of neighbours
    skip: np.ndarray  # of tokens that share a key


def skip_edges(text: str, toks: list[Token]) -> list[tuple[int, int]]:
    """Each token with the one before it of the same key, and with the first one of the key that the patterns found (else the
    first of all): repeats are tied in a row and to one place, so that a label is few edges away and edges are at most six a
    token."""
    of_key: dict[str, list[int]] = {}
    for i, t in enumerate(toks):
        for k in keys(text, t):
            of_key.setdefault(k, []).append(i)
    out = set()
    for same in of_key.values():
        centre = next((i for i in same if toks[i].label), same[0])
        for i, j in zip(same, same[1:], strict=False):
            if i != j:
                out.add((i, j))
        out |= {(min(i, centre), max(i, centre)) for i in same if i != centre}
    return sorted(out)


def connected(n: int, edges: list[tuple[int, int]], seeds: list[int]) -> set[int]:
    """The nodes that edges connect with a seed, over any number of edges."""
    near: dict[int, list[int]] = {}
    for i, j in edges:
        near.setdefault(i, []).append(j)
        near.setdefault(j, []).append(i)
    seen, todo = set(seeds), list(seeds)
    while todo:
        for j in near.get(todo.pop(), ()):
            if j not in seen:
                seen.add(j)
                todo.append(j)
    return seen


def marginals(node: np.ndarray, edges: list[tuple[int, int, np.ndarray]]) -> np.ndarray:
    """Loopy sum-product: label probabilities of each node (rows), with damped messages along all edges at once."""
    unary = np.exp(node - node.max(1, keepdims=True))
    if not edges:
        return unary / unary.sum(1, keepdims=True)
    a = np.array([e[0] for e in edges] + [e[1] for e in edges])
    b = np.array([e[1] for e in edges] + [e[0] for e in edges])
    pot = np.exp(np.stack([e[2] for e in edges] + [e[2].T for e in edges]))
    m, back = len(edges), np.r_[np.arange(len(edges), 2 * len(edges)), np.arange(len(edges))]
    message = np.full((2 * m, LABELS), 1.0 / LABELS)
    for _ in range(ROUNDS):
        total = np.log(unary + 1e-300)
        np.add.at(total, b, np.log(message))
        out = total[a] - np.log(message[back])
        out = np.exp(out - out.max(1, keepdims=True))
        new = np.einsum("ei,eij->ej", out, pot)
        new = np.maximum(new / new.sum(1, keepdims=True), 1e-12)
        change = np.abs(new - message).max()
        message = DAMPING * message + (1 - DAMPING) * new
        if change < SETTLED:
            break
    belief = np.log(unary + 1e-300)
    np.add.at(belief, b, np.log(message))
    belief = np.exp(belief - belief.max(1, keepdims=True))
    return belief / belief.sum(1, keepdims=True)


def all_spans(text: str, field: Field) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans): the base spans stay; the field adds tokens that it is confident of."""
    base = base_spans(text)
    toks = tokens(text, base) if base else []  # labels come from what repeats or resembles a found span
    free = [i for i, t in enumerate(toks) if not t.label]
    if not free:
        return base, base
    skips = skip_edges(text, toks)
    # a component of skip edges without a found span has nothing to carry
    reach = connected(len(toks), skips, [i for i, t in enumerate(toks) if t.label])
    if not any(i in reach for i in free):
        return base, base
    node = np.zeros((len(toks), LABELS))
    for i, t in enumerate(toks):
        if t.label:
            node[i] = -50.0
            node[i, t.label] = 0.0
        else:
            node[i] = field.weights[features(text, t)].sum(0)
    tied = set(skips)
    edges = [(i, i + 1, field.chain) for i in range(len(toks) - 1) if (i, i + 1) not in tied] + [(i, j, field.skip) for i, j in skips]
    p = marginals(node, edges)
    more = []
    for i in free:
        k = int(p[i].argmax())
        if k and p[i, k] >= CONFIDENT and i in reach:
            more.append((toks[i].start, toks[i].end, KINDS[k - 1]))
    return base, sorted({*base, *more}, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _examples(batches):
    """Of each document with tokens: features and labels of its tokens, neighbour and skip pairs of labels."""
    for batch in batches:
        docs, many, rows = [], [], []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            toks = tokens(text, base_spans(text))
            if not toks:
                continue
            skips = skip_edges(text, toks)
            flat = []
            for t in toks:
                f = features(text, t)
                flat += [t.label, len(f), *f.tolist()]
            flat += [-1]
            for i in range(len(toks) - 1):
                flat += [toks[i].label * LABELS + toks[i + 1].label]
            flat += [-1]
            for i, j in skips:
                flat += [toks[i].label * LABELS + toks[j].label]
            docs.append(doc)
            many.append(len(toks))
            rows.append(np.array(flat, np.int32).tobytes())
        columns = [pa.array(docs, pa.int64()), pa.array(many, pa.int64()), pa.array(rows, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "many", "example"])


def fit(docs: DataFrame, most: int = FIT_DOCS) -> Field:
    """Learn the field from what the patterns find in at most `most` documents with FIT_TOKENS tokens together (stated
    bounds), by pieces: the nodes' weights by multinomial logistic regression, the edges' potentials as smoothed log ratios
    of pairs to chance. Of several rows of an id one takes part; null ids take no part."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).where(F.col("text").rlike("[0-9@]"))
    some = rows.where("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    made = rows.join(F.broadcast(some), "doc_id").mapInArrow(_examples, "doc_id long, many long, example binary")
    one = saved(made.groupBy("doc_id").agg(F.min(F.struct("example", "many")).alias("x")).select("doc_id", "x.many", "x.example"), "examples")
    upto = F.sum("many").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))  # over `most` narrow rows at most
    few = one.select("doc_id", "many").withColumn("upto", upto).where(F.col("upto") <= FIT_TOKENS).select("doc_id")
    got = one.join(F.broadcast(few), "doc_id").toArrow().sort_by("doc_id")
    x, y, chain, skip = [], [], np.ones((LABELS, LABELS)), np.ones((LABELS, LABELS))
    skip += 4 * np.eye(LABELS)  # what is alike is taken to be alike, also where few pairs were seen
    for raw in got.column("example").to_pylist():
        flat = np.frombuffer(raw, np.int32).tolist()
        k = 0
        while flat[k] != -1:
            n = flat[k + 1]
            y.append(flat[k])
            x.append(flat[k + 2 : k + 2 + n])
            k += 2 + n
        k += 1
        while flat[k] != -1:
            chain[divmod(flat[k], LABELS)] += 1
            k += 1
        for pair in flat[k + 1 :]:
            skip[divmod(pair, LABELS)] += 1
    return Field(_logistic(x, np.array(y, np.int64)), _ratio(chain), _ratio(skip + skip.T))


def _ratio(count: np.ndarray) -> np.ndarray:
    joint = count / count.sum()
    chance = joint.sum(1, keepdims=True) * joint.sum(0, keepdims=True)
    return np.clip(np.log(joint / chance), -4, 4)


def _logistic(x: list[list[int]], y: np.ndarray, rounds: int = 200, rate: float = 0.5, shrink: float = 1e-3) -> np.ndarray:
    w = np.zeros((FEATURES, LABELS))
    if not len(y):
        return w
    a = np.zeros((len(x), FEATURES), np.float32)
    for i, f in enumerate(x):
        a[i, f] = 1
    target = np.eye(LABELS)[y]
    for _ in range(rounds):
        s = a @ w
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        w -= rate * (a.T @ (p - target) / len(x) + shrink * w)
    return w


def render(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{z}" for a, z, k in spans)


def _run(shared):
    def run(batches):
        import hashlib

        field = shared.value
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                base, every = all_spans(text, field) if "@" in text or _DIGIT.search(text) else ([], [])
                n = [sum(s[2] == k for s in base) for k in KINDS]
                out.append((*n, hashlib.sha256(render(base).encode()).hexdigest(), render(every)))
            names = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array([r[i] for r in out], kinds[i]) for i in range(6)]], names=["doc_id", *names])

    return run


def find_personal_data(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of the patterns' spans, and spans (all, kind:start:end, in code points).

    Each document is read whole and by itself, in time in proportion to its length. The patterns' spans always stay. Of
    texts with such a span, words with a digit or an @ are nodes of a field whose edges join neighbours and tokens that
    repeat or resemble each other (same digits, same last ten digits, same address or local part); loopy message passing
    gives each a label, and those of at least 0.9 are added where edges between alike tokens connect them with a span
    that the patterns found, over any number of them. A text without such a span has no label to carry, and so none is
    added. Null text counts as empty; texts without personal data have no spans (an empty string);
    repeated rows are each a row of the result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(_run(shared), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
