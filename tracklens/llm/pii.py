"""Personal data by base patterns and a skip-chain conditional random field.

Four patterns (e-mail, IP address, card number, phone number) give the base spans, which always stay. The field adds
what they miss. Its nodes are a document's tokens between white space that hold a digit or an at sign; every other token
is outside for certain, which cuts the chain there without changing the result.
Labels are the four kinds and "outside". A node's potential comes from its shape, its length, its marks and the words
beside it; neighbouring nodes share a chain potential, and distant tokens that repeat (equal letters and digits) or are
similar (equal last seven digits) share a skip potential: each is linked to the next one that has the same key, so
links grow with the tokens, not with their pairs. Tokens in base spans are observed. Loopy message passing over all of
a document's links then carries labels to its other mentions: a phone number written once in full makes the field find
it where the country code is missing.

The weights are learnt from the base spans of a bounded sample, without labels by hand: base spans are also written in
ways that the patterns miss (without country code, with other gaps, spelt-out at signs), near a full mention or alone,
and numbers of other kinds stay outside. Learning follows the gradient of the likelihood with marginals by the same
message passing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, hashed_sample

KINDS = ("email", "ip", "card", "phone")
OUTSIDE, LABELS = len(KINDS), len(KINDS) + 1
FEATURES, CHAIN, REPEATED, SIMILAR = 4096, 0, 1, 2
ROUNDS, DAMPING, CLOSE = 40, 0.3, 1e-4
NODES = 100_000  # of the documents whose messages pass together

#: The base patterns' character classes.
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_EMAIL_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_MARK, _SPACE = re.compile(r"[0-9@]"), re.compile(r"\s")
_CORE = re.compile(r"[^0-9A-Za-z]+")
#: Characters that may end a found span on either side, by kind.
_EDGE = {"email": (r"[A-Za-z0-9]", r"[A-Za-z0-9]"), "ip": (r"[0-9]", r"[0-9]"), "card": (r"[0-9]", r"[0-9]"), "phone": (r"[+(0-9]", r"[0-9]")}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The leftmost non-overlapping matches of the pattern. A match's local part is all of the local characters before
    its at sign, and no start to the left of another can succeed where that one fails; so each at sign is tried once."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        host = _EMAIL_HOST.match(text, at + 1) if start < at else None
        if host:
            yield start, host.end()
            free = host.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, free))


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, by kind, then start; a span that fails its kind's test is dropped."""
    text, out = text or "", []
    if not _MARK.search(text):
        return out
    if "@" in text:
        out += [(0, a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def _tokens(text: str) -> Iterator[tuple[int, int]]:
    """The runs between white space that hold a digit or an at sign."""
    free = 0
    while mark := _MARK.search(text, free):
        start = mark.start()
        while start > free and not text[start - 1].isspace():
            start -= 1
        space = _SPACE.search(text, mark.end())
        free = space.start() if space else len(text)
        yield start, free


@cache
def _hashed(name: str) -> int:
    return xxhash.xxh32_intdigest(name) % FEATURES


def _shape(token: str) -> str:
    """Letters as a, digits as 9, runs of over four as of four."""
    out = re.sub(r"[^\W\d_]", "a", re.sub(r"[0-9]", "9", token[:40]))
    return re.sub(r"(.)\1{4,}", r"\1\1\1\1", out)


def token_features(token: str, before: str, after: str, first: bool) -> list[int]:
    """Places of the features of a token with the words (or tokens) beside it."""
    digits, letters = sum(c in "0123456789" for c in token), sum(c.isalpha() for c in token)
    core = token.strip(",.;:!?\"'()[]{}<>*#&$%")
    names = [
        "bias", f"shape={_shape(core)}", f"digits={min(digits, 20)}", f"letters={min(letters, 6)}", f"at={core.count('@')}", f"dots={min(core.count('.'), 4)}",
        f"dashes={min(core.count('-'), 4)}", f"plus={core[:1] == '+'}", f"open={token[:1] == '('}", f"before={_shape(before) if re.search('[0-9@]', before) else before.lower()[:20]}",
        f"after={_shape(after) if re.search('[0-9@]', after) else after.lower()[:20]}", f"kind={_shape(core)}|{_shape(before)[:12] if re.search('[0-9@]', before) else ''}", f"first={first}",
    ]
    return [_hashed(n) for n in names]


WIDTH = len(token_features("1", "", "", True))


def _keys(token: str) -> list[tuple[int, str]]:
    """What links a token to others: its letters and digits, and the last seven of its digits."""
    core, digits = _CORE.sub("", token).lower(), re.sub(r"[^0-9]", "", token)
    keys = [(REPEATED, core)] if len(core) >= 3 else []
    return keys + ([(SIMILAR, digits[-7:])] if len(digits) >= 7 else [])


@dataclass
class Graph:
    """Nodes and links of one or more documents."""

    features: list[list[int]] = field(default_factory=list)
    places: list[tuple[int, int, int]] = field(default_factory=list)  # document, start, end
    seen: list[int] = field(default_factory=list)  # an observed label, or -1
    links: list[tuple[int, int, int]] = field(default_factory=list)  # node, node, kind of link

    def add(self, doc: int, text: str, spans: list[tuple[int, int, int]]) -> None:
        """A document's tokens; those that base spans touch are observed, by the first span that does."""
        if not text:
            return
        marks, at, reach, ends = sorted((a, b, k) for k, a, b in spans), 0, 0, []
        for _, b, _ in marks:
            reach = max(reach, b)
            ends.append(reach)
        last: dict[tuple[int, str], int] = {}
        previous = None
        for start, end in _tokens(text):
            token, node = text[start:end], len(self.features)
            while at < len(marks) and ends[at] <= start:
                at += 1
            label, j = -1, at
            while label < 0 and j < len(marks) and marks[j][0] < end:
                label = marks[j][2] if marks[j][1] > start else -1
                j += 1
            joined = previous is not None and not text[previous[0] : start].strip()
            before = previous[1] if joined else "".join(text[max(0, start - 60) : start].split()[-1:])
            self.features.append(token_features(token, before, "".join(text[end : end + 60].split()[:1]), not joined))
            self.places.append((doc, start, end))
            self.seen.append(label)
            if joined:
                self.links.append((node - 1, node, CHAIN))
            for key in _keys(token):
                if key in last:
                    self.links.append((last[key], node, key[0]))
                last[key] = node
            previous = (end, token)


@dataclass
class Field:
    """Weights of features and labels, and of pairs of labels by kind of link."""

    nodes: np.ndarray
    pairs: np.ndarray

    def marginals(self, features: np.ndarray, links: np.ndarray, seen: np.ndarray, want_pairs: bool = False, rounds: int = ROUNDS):
        """Each node's distribution over labels by loopy message passing (exact where the links form no loop), and each
        link's over pairs of labels."""
        score = self.nodes[features].sum(1) if len(features) else np.zeros((0, LABELS))
        held = seen >= 0
        score = np.where(held[:, None], np.where(np.arange(LABELS) == seen[:, None], 0.0, -50.0), score)
        a, b, kind = links.T if len(links) else np.zeros((3, 0), int)
        source, target = np.r_[a, b], np.r_[b, a]
        pot = np.concatenate([self.pairs[kind], self.pairs[kind].transpose(0, 2, 1)])  # from source's label to target's
        back = np.r_[np.arange(len(a)) + len(a), np.arange(len(a))]
        messages = np.zeros((len(source), LABELS))
        top = pot.max((1, 2), keepdims=True) if len(pot) else pot
        weight = np.exp(pot - top)
        order = np.argsort(target, kind="stable")
        cuts = np.searchsorted(target[order], np.arange(len(score) + 1))
        total = np.zeros_like(score)

        def gather():
            sums = np.zeros((len(source) + 1, LABELS))
            np.cumsum(messages[order], axis=0, out=sums[1:])
            return score + sums[cuts[1:]] - sums[cuts[:-1]]

        for _ in range(rounds if len(source) else 0):
            total = gather()
            cavity = total[source] - messages[back]
            cavity -= cavity.max(1, keepdims=True)
            new = np.log(np.einsum("es,est->et", np.exp(cavity), weight) + 1e-300)
            new -= new.max(1, keepdims=True)
            step = (1 - DAMPING) * (new - messages)
            messages = messages + step
            if np.abs(step).max() < CLOSE:
                break
        total = gather() if len(source) else score
        belief = np.exp(total - total.max(1, keepdims=True)) if len(total) else total
        belief = belief / belief.sum(1, keepdims=True) if len(total) else belief
        if not want_pairs:
            return belief
        left, right = total[a] - messages[len(a) :], total[b] - messages[: len(a)]
        joint = left[:, :, None] + right[:, None, :] + self.pairs[kind]
        joint = np.exp(joint - joint.max((1, 2), keepdims=True)) if len(joint) else joint
        return belief, joint / joint.sum((1, 2), keepdims=True) if len(joint) else joint


def _arrays(g: Graph) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.array(g.features, int).reshape(-1, WIDTH), np.array(g.links, int).reshape(-1, 3), np.array(g.seen, int)


def variants(kind: int, span: str) -> list[str]:
    """Other ways to write a base span, which the patterns miss."""
    digits = re.sub(r"[^0-9]", "", span)
    if kind == 0:
        name, host = span.rsplit("@", 1)
        return [f"{name}@{host.replace('.', '(dot)')}", f"{name}[@]{host}"]
    if kind == 1:
        return [span.replace(".", "-"), span.replace(".", "[.]")]
    if kind == 2:
        fours = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        return ["/".join(fours), ".".join(fours)]
    a, b, c = digits[-10:-7], digits[-7:-4], digits[-4:]
    return [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}"]


def _training(texts: list[str], seed: int) -> tuple[Graph, np.ndarray]:
    """A graph of the texts with nothing observed, and each node's label: what base spans touch has their kind, also
    where a span was replaced by a variant or a variant was added further on."""
    rng, g, truth = np.random.default_rng(seed), Graph(), []
    for doc, text in enumerate(texts):
        spans = base_spans(text)
        versions = [(text, spans)]
        if spans:
            for alone in (True, False):
                pieces, marks, at, size = [], [], 0, 0
                for k, a, b in sorted(spans, key=lambda s: s[1]):
                    if a < at:
                        continue
                    ways = variants(k, text[a:b])
                    way = ways[rng.integers(len(ways))]
                    for part in (text[at:a], way if alone else text[a:b]):
                        pieces.append(part)
                        size += len(part)
                    marks.append((k, size - len(pieces[-1]), size))
                    at = b
                    if not alone:  # again, some words later
                        gap = text.find(" ", min(b + 40, len(text)))
                        gap = gap if gap >= 0 else len(text)
                        if all(not (x < gap < y) for _, x, y in spans) and not any(b <= x < gap + 1 for _, x, _ in spans):
                            pieces += [text[b:gap] + " ", way]
                            size += gap - b + 1 + len(way)
                            marks.append((k, size - len(way), size))
                            at = gap
                pieces.append(text[at:])
                versions.append(("".join(pieces), marks))
        for version, marks in versions:
            start = len(g.features)
            g.add(doc, version, marks)
            truth += [s if s >= 0 else OUTSIDE for s in g.seen[start:]]
            g.seen[start:] = [-1] * (len(g.seen) - start)
    return g, np.array(truth, int)


def learn(texts: list[str], *, seed: int = 12, rounds: int = 80, rate: float = 0.3, l2: float = 0.02, most_nodes: int = 100_000) -> Field:
    """Fits the field by AdaGrad on the likelihood's gradient; with no token to learn from every weight is zero but for
    "outside". Nodes beyond most_nodes are left out, document by document (a bound on the fit alone)."""
    g, truth = _training(texts, seed)
    features, links, _ = _arrays(g)
    if len(features) > most_nodes:
        features, truth = features[:most_nodes], truth[:most_nodes]
        links = links[(links[:, 0] < most_nodes) & (links[:, 1] < most_nodes)]
    out = Field(np.zeros((FEATURES, LABELS)), np.zeros((3, LABELS, LABELS)))
    out.nodes[_hashed("bias"), OUTSIDE] = 1.0
    if not len(features):
        return out
    n, want = len(features), np.eye(LABELS)[truth]
    a, b, kind = links.T if len(links) else np.zeros((3, 0), int)
    pair_truth = want[a][:, :, None] * want[b][:, None, :]
    sums = [np.full_like(out.nodes, 1e-8), np.full_like(out.pairs, 1e-8)]
    free = np.full(n, -1)
    for _ in range(rounds):
        belief, joint = out.marginals(features, links, free, True, 10)
        flat, gain = features.reshape(-1), np.repeat(want - belief, WIDTH, axis=0)
        up = np.stack([np.bincount(flat, gain[:, k], FEATURES) for k in range(LABELS)], axis=1) - l2 * out.nodes
        pair_up = np.zeros_like(out.pairs)
        np.add.at(pair_up, kind, pair_truth - joint)
        for k in (REPEATED, SIMILAR):  # these links have no direction
            pair_up[k] = (pair_up[k] + pair_up[k].T) / 2
        pair_up -= l2 * out.pairs
        for weights, change, seen in ((out.nodes, up, sums[0]), (out.pairs, pair_up, sums[1])):
            seen += change**2
            weights += rate * change / np.sqrt(seen)
    return out


def _trimmed(text: str, kind: int, start: int, end: int) -> tuple[int, int] | None:
    """The span without the marks that stand beside it; a span must keep seven digits (or an at sign)."""
    left, right = _EDGE[KINDS[kind]]
    found = re.search(rf"{left}(?:.*{right})?", text[start:end], re.S)
    if not found:
        return None
    a, b = start + found.start(), start + found.end()
    core = text[a:b]
    enough = "@" in core if kind == 0 else sum(c in "0123456789" for c in core) >= (4 if kind == 1 else 7)
    return (a, b) if enough else None


def found_spans(texts: list[str | None], model: Field, sure: float = 0.9) -> list[tuple[list, list]]:
    """(base spans, added spans) of each text. A run of neighbouring tokens that the field labels alike, each with a
    probability of `sure` at least, none in a base span, is one added span."""
    bases = [base_spans(t) for t in texts]
    added: list[list] = [[] for _ in texts]
    graph = Graph()

    def decide():
        features, links, seen = _arrays(graph)
        belief = model.marginals(features, links, seen)
        chained = set(links[links[:, 2] == CHAIN, 1].tolist())
        label, p = belief.argmax(1), belief.max(1)
        run = None
        for i in [*np.flatnonzero((label != OUTSIDE) & (p >= sure) & (seen < 0)).tolist(), None]:
            if run and i is not None and i == run[1] + 1 and i in chained and label[i] == run[2]:
                run = (run[0], i, run[2])
                continue
            if run:
                doc, start = graph.places[run[0]][:2]
                span = _trimmed(texts[doc], int(run[2]), start, graph.places[run[1]][2])
                if span:
                    added[doc].append((int(run[2]), *span))
            run = (i, i, label[i]) if i is not None else None

    for doc, text in enumerate(texts):
        graph.add(doc, text or "", bases[doc])
        if len(graph.features) >= NODES:
            decide()
            graph = Graph()
    if graph.features:
        decide()
    return list(zip(bases, added, strict=True))


def span_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def fit_field(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 4000, longest: int = 20_000) -> Field:
    """The field, learnt on the driver's behalf in one task from at most sample_rows documents that hold a digit or an
    at sign and at most `longest` characters: those of the smallest hashes of id and text. The weights are of fixed size.
    """
    text = F.col(text_col)
    rows = documents.filter(text.rlike("[0-9@]") & (F.length(text) <= longest)).select(F.xxhash64(F.col(id_col), text).alias("_key"), text.alias("_text"))

    def fit(t: pa.Table) -> pa.Table:
        pairs = sorted(zip(t["_key"].to_pylist(), t["_text"].to_pylist(), strict=True))
        model = learn([x for _, x in pairs])
        return pa.table({"nodes": pa.array([model.nodes.tobytes()], pa.binary()), "pairs": pa.array([model.pairs.tobytes()], pa.binary())})

    found = hashed_sample(rows, F.col("_key"), sample_rows).groupBy().applyInArrow(fit, "nodes binary, pairs binary").collect()
    if not found:
        return learn([])
    return Field(np.frombuffer(found[0]["nodes"]).reshape(FEATURES, LABELS).copy(), np.frombuffer(found[0]["pairs"]).reshape(3, LABELS, LABELS).copy())


SPANS = "array<struct<kind:string,start:long,end:long,added:boolean>>"


def with_personal_data(documents: DataFrame, model: Field, *, text_col: str = "text", name: str = "spans", sure: float = 0.9) -> DataFrame:
    """documents with a column `name`: an array of (kind, start, end, added), by kind, then start, in code points, end
    exclusive; base spans are those not added.

    Null and empty texts have none. Texts are searched whole; very long ones are no different. Repeated rows get the
    same spans, other columns may have any name but `name`.
    """
    bounded_batches(documents.sparkSession)
    context = documents.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out = []
            for base, added in found_spans(texts.to_pylist(), context.value, sure):
                every = sorted([(k, a, b, False) for k, a, b in base] + [(k, a, b, True) for k, a, b in added])
                out.append([{"kind": KINDS[k], "start": a, "end": b, "added": more} for k, a, b, more in every])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("added", pa.bool_())]))
            yield pa.array(out, kind)

    return documents.withColumn(name, F.arrow_udf(search, SPANS)(F.col(text_col)))
