r"""Personal data with a skip-chain conditional random field.

Exact patterns give the base spans. The field adds what they miss: a phone number without its plus sign,
the name before an @ used on its own, a number that stands where numbers of that kind stand.

Nodes are mentions: base spans, other numbers of at least seven digits, and words built like names of
addresses (with an inner dot, dash or underscore, or equal to the name of an address in the same text).
What a node shows of itself never tells a base span from another mention: of a phone number the last
groups of digits without the plus sign, of an address its name, of a card number no check sum. So base
spans are labelled examples for what the patterns miss. All potentials are logs of ratios of corpus counts,
each estimated by itself (piecewise), shrunk to no effect where little was seen, and held by ``UNKNOWN``:

* own evidence: label against "none" by shape (sizes of the last three groups of digits, build of a name),
  by the word before (``CONTEXTS`` hashed classes), and by whether letters or digits touch the mention;
* chain: how much likelier two labels follow each other than by chance;
* skip links between distant mentions. Those with one key (the same digits, the last ten of them, the same
  name) agree as often as linked base spans do; those with the same shape and the same word before, "alike",
  by the counts of their pairs of labels. A link to a rare label weighs more than one to a common label.

A mention with the key of a base span may be personal data that the patterns missed: it is hidden and
counted nowhere. All others without a base span count as "none".

Base spans are clamped. A mention is linked to the first base span of each label with its key, so a label
reaches the hundredth repeat as it does the first; mentions whose keys no base span has are linked each
to the next. A text of n mentions has O(n) links. Sum-product messages pass over all links (a graph with
loops) until they settle, ``ROUNDS`` at most, which ``settled`` tells. A mention becomes a span where
the probability of its likeliest label is ``CERTAIN`` or more, whether or not its text has base spans.

``recover`` measures the field on base spans that it is not told of, beside a look-up of keys.

Scale: no text is shuffled. Corpus counts are a table of at most (shapes + ``CONTEXTS``) x labels rows, both
bounded by the code and not by the data, summed with map-side combining. Every text is judged whole and
by itself.

Defined results: null text is empty, without spans; repeated rows are judged alike; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
NONE = len(KINDS)
CERTAIN = 0.9
CONTEXTS = 4096
#: Share of each label's mentions taken to look like any mention: the patterns, and so the counts, do not
#: know all forms. It bounds what one feature says against a label, however large the corpus.
UNKNOWN = 0.05
#: Seen counts that weigh as much as no effect does, of shapes, contexts and pairs.
SHRINK = {"shape": 1.0, "before": 5.0, "glue": 5.0, "chain": 20.0, "alike": 20.0}
PARTS = frozenset({"shape", "before", "glue", "chain", "alike", "key"})
ROUNDS = 1_000

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NUMBER = re.compile(r"[0-9](?:[ ().\-/]{0,2}[0-9])++")
RUN = re.compile(r"[0-9]++")
NAME = re.compile(r"[A-Za-z0-9._%+-]{6,}")
BUILT = re.compile(r"[A-Za-z0-9]++(?:[._-][A-Za-z0-9]++)++")
BEFORE = re.compile(r"([A-Za-z\x80-\U0010FFFF]+)[^A-Za-z0-9\x80-\U0010FFFF]{0,4}$")
LETTERS, DIGITS = re.compile(r"[A-Za-z]+"), re.compile(r"[0-9]+")
DIGIT = re.compile(r"[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]")

Span = tuple[int, int, int]  # start, end, place of the kind in KINDS


def luhn(digits: str) -> bool:
    """Whether the check sum of a card number holds."""
    from_right = [ord(c) - 48 for c in reversed(digits)]
    doubled = [d * 2 - 9 if d > 4 else d * 2 for d in from_right[1::2]]
    return (sum(from_right[::2]) + sum(doubled)) % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    done = 0  # end of the last match, or behind the last @ that made none
    at = text.find("@")
    while at >= 0:
        before = text[done:at]
        name = len(before) - len(before.rstrip(LOCAL))
        found = DOMAIN.match(text, at) if name else None
        done = found.end() if found else at + 1
        if found:
            yield at - name, done, 0
        at = text.find("@", done)


def base_spans(text: str) -> list[Span]:
    """The exact patterns' spans by start, then kind."""
    spans = list(_emails(text)) if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255 for part in m[0].split(".")):
                spans.append((m.start(), m.end(), 1))
        for m in CARD.finditer(text):
            digits = NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                spans.append((m.start(), m.end(), 2))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                    spans.append((m.start(), m.end(), 3))
    return sorted(spans, key=lambda s: (s[0], s[2], s[1]))


class Mention(NamedTuple):
    """A node; ``label`` is ``NONE`` if it is not a base span."""

    start: int
    end: int
    label: int
    shape: str
    before: str
    glue: str
    keys: tuple[str, ...]


def _name_shape(name: str) -> str:
    return "w" + DIGITS.sub("0", LETTERS.sub("a", name))[:6]


def mentions(text: str, base: list[Span]) -> list[Mention]:
    """Every node, by start."""

    def node(start: int, end: int, label: int, shape: str, keys: tuple[str, ...]) -> Mention:
        word = BEFORE.search(text, max(0, start - 24), start)
        before = str(zlib.crc32(word[1].lower().encode("utf-8", "surrogatepass")) % CONTEXTS) if word else ""
        touched = f"{int(text[start - 1 : start].isalnum())}{int(text[end : end + 1].isalnum())}"
        return Mention(start, end, label, shape, before, touched, keys)

    def number(start: int, end: int, label: int) -> Mention:
        groups = RUN.findall(text, start, end)
        digits = "".join(groups)
        keys = ("n" + digits,) + (("t" + digits[-10:],) if len(digits) > 9 else ())
        dotted = len(groups) == 4 and text.count(".", start, end) == 3
        shape = "d4" if dotted else "n" + "-".join(str(min(len(g), 20)) for g in groups[-3:])
        return node(start, end, label, shape, keys)

    found, names = [], set()
    for start, end, kind in base:
        if kind == 0:
            address = text[start:end].lower()
            name = address.partition("@")[0]
            if len(name) >= 6 and any(map(str.isalpha, name)):
                names.add(name)
            found.append(node(start, end, kind, _name_shape(name), ("a" + address, "w" + name)))
        else:
            found.append(number(start, end, kind))
    taken = sorted((s, e) for s, e, _ in base)
    rest, reach = [], 0
    if DIGIT.search(text):
        for m in NUMBER.finditer(text):
            n_digits = len(NOT_DIGIT.sub("", m[0]))
            if n_digits > 19:  # several numbers side by side
                rest += [number(r.start(), r.end(), NONE) for r in RUN.finditer(text, m.start(), m.end()) if len(r[0]) >= 7]
            elif n_digits >= 7:
                rest.append(number(m.start(), m.end(), NONE))
    words = {m.span() for m in BUILT.finditer(text) if len(m[0]) >= 6 and LETTERS.search(m[0])}
    if names:
        words |= {m.span() for m in NAME.finditer(text) if m[0].lower() in names}
    rest += [node(a, b, NONE, _name_shape(text[a:b]), ("w" + text[a:b].lower(),)) for a, b in words]
    rest.sort()
    i = 0
    for one in rest:  # only what no base span and no earlier mention touches
        while i < len(taken) and taken[i][0] < one.end:
            reach = max(reach, taken[i][1])
            i += 1
        if one.start >= reach:
            found.append(one)
            reach = one.end
    return sorted(found)


def anchors_of(nodes: list[Mention]) -> dict[str, dict[int, int]]:
    """First base span of each label, by key."""
    anchors: dict[str, dict[int, int]] = {}
    for i, node in enumerate(nodes):
        if node.label != NONE:
            for key in node.keys:
                anchors.setdefault(key, {}).setdefault(node.label, i)
    return anchors


def links(nodes: list[Mention]) -> dict[tuple[int, int], str]:
    """Links as pairs of node numbers with what they are: a key's first letter, ``alike`` or ``chain``.
    Where two nodes have several, the first of these holds."""
    anchors = anchors_of(nodes)
    last: dict[str, int] = {}
    found: dict[tuple[int, int], str] = {}
    for i, node in enumerate(nodes):
        anchored = False
        if node.label == NONE:
            for key in node.keys:
                for a in anchors.get(key, {}).values():
                    found.setdefault((min(a, i), max(a, i)), key[0])
                    anchored = True
        if not anchored:
            for key in node.keys:
                if key in last:
                    found.setdefault((last[key], i), key[0])
                last[key] = i
        if node.before:
            alike = f"{node.shape} {node.before}"
            if alike in last:
                found.setdefault((last[alike], i), "alike")
            last[alike] = i
        if i:
            found.setdefault((i - 1, i), "chain")
    return found


def infer(own: np.ndarray, edges: np.ndarray, potentials: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, bool]:
    """Marginals by loopy sum-product, and whether the messages settled. ``own[node, label]`` and
    ``potentials[edge, a, b]`` are logs."""
    n, k = own.shape
    if not len(edges):
        return np.exp(own - np.logaddexp.reduce(own, 1, keepdims=True)), True
    source = np.concatenate([edges[:, 0], edges[:, 1]])
    target = np.concatenate([edges[:, 1], edges[:, 0]])
    back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
    settled = False
    pair = np.concatenate([potentials, potentials.transpose(0, 2, 1)])
    message = np.zeros((len(source), k))
    for _ in range(rounds):
        belief = own.copy()
        np.add.at(belief, target, message)
        new = np.logaddexp.reduce((belief[source] - message[back])[:, :, None] + pair, 1)
        new -= np.logaddexp.reduce(new, 1, keepdims=True)
        moved = np.abs(new - message).max()
        message = 0.5 * message + 0.5 * new
        if settled := bool(moved < 1e-6):
            break
    belief = own.copy()
    np.add.at(belief, target, message)
    return np.exp(belief - np.logaddexp.reduce(belief, 1, keepdims=True)), settled


class Field:
    """Potentials from corpus counts ``(what, a, b) -> n``; ``parts`` names those that are used."""

    def __init__(self, counts: dict[tuple[str, str, str], int], parts: frozenset[str] = PARTS):
        self.parts = parts
        k = NONE + 1
        seen: dict[str, dict[str, np.ndarray]] = {what: {} for what in ("shape", "before", "glue")}
        pairs = {what: np.zeros((k, k)) for what in ("chain", "alike")}
        agree: dict[str, np.ndarray] = {}
        for (what, a, b), n in sorted(counts.items()):
            if what in seen:
                seen[what].setdefault(a, np.zeros(k))[int(b)] += n
            elif what in pairs:
                pairs[what][int(a), int(b)] += n
                pairs[what][int(b), int(a)] += n
            else:
                agree.setdefault(a, np.ones(2))[int(b)] += n
        # Words and numbers have shares of labels of their own: most words are no one's name.
        self.share = {}
        for letter in "nw":
            of_kind = sum((n for shape, n in seen["shape"].items() if (shape[0] == "w") == (letter == "w")), np.full(k, 0.5))
            self.share[letter] = of_kind / of_kind.sum()
        self.seen: dict[tuple[str, str], np.ndarray] = {}
        for what, values in seen.items():
            total = sum(values.values(), np.full(k, 0.5))
            for value, n in values.items():
                share = total / total.sum() if what != "shape" else self.share["w" if value[0] == "w" else "n"]
                held = (n + SHRINK[what] * share) / (n.sum() + SHRINK[what])
                self.seen[what, value] = np.log((1 - UNKNOWN) * held / share + UNKNOWN)
        self.pairs = {}
        for what, n in pairs.items():
            chance = n.sum(1, keepdims=True) * n.sum(0, keepdims=True) / max(n.sum(), 1)
            self.pairs[what] = np.log((n + SHRINK[what]) / (chance + SHRINK[what]))
        self.agree = {kind: float(n[1] / n.sum()) for kind, n in agree.items()}

    def potential(self, kind: str, letter: str) -> np.ndarray:
        """Of a link: log of how much likelier a label is beside another than by its share."""
        part = kind if kind in self.pairs else "key"
        if part not in self.parts:
            return np.zeros((NONE + 1, NONE + 1))
        if kind in self.pairs:
            return self.pairs[kind]
        share, same = self.share[letter], self.agree.get(kind, 0.5)
        other = np.log((1 - same) / (1 - share))
        table = (other[:, None] + other[None, :]) / 2
        table[NONE], table[:, NONE] = other, other
        np.fill_diagonal(table, np.log(same / share))
        table[NONE, NONE] = -np.log(share[NONE])  # counts say nothing of two that are both none: taken to agree
        return table

    def evidence(self, node: Mention) -> np.ndarray:
        """Log odds of every label against none."""
        own = np.log(self.share["w" if node.shape[0] == "w" else "n"])
        for what in ("shape", "before", "glue"):
            if what in self.parts and (what, getattr(node, what)) in self.seen:
                own = own + self.seen[what, getattr(node, what)]
        return own - own[NONE]

    def judge(self, nodes: list[Mention]) -> tuple[np.ndarray, bool]:
        """Probabilities of the labels of all nodes, base spans clamped, and whether they settled."""
        own = np.array([self.evidence(node) for node in nodes])
        label = np.array([node.label for node in nodes])
        base = label != NONE
        own[base] = np.where(np.arange(NONE + 1) == label[base, None], 0.0, -1e6)  # no number of links outvotes it
        joined = links(nodes)
        tables = {}
        potentials = np.zeros((len(joined), NONE + 1, NONE + 1))
        for e, ((i, _), kind) in enumerate(joined.items()):
            key = kind, "w" if nodes[i].shape[0] == "w" else "n"
            if key not in tables:
                tables[key] = self.potential(*key)
            potentials[e] = tables[key]
        return infer(own, np.array(list(joined), np.int64).reshape(-1, 2), potentials)

    def added(self, text: str, base: list[Span]) -> tuple[list[Span], bool]:
        """Spans of mentions that the field labels, and whether its messages settled."""
        nodes = mentions(text, base)
        if all(node.label != NONE for node in nodes):
            return [], True
        chance, settled = self.judge(nodes)
        label = np.where(chance.max(1) >= CERTAIN, chance.argmax(1), NONE)
        return [(n.start, n.end, int(k)) for n, k in zip(nodes, label) if n.label == NONE and k != NONE], settled


def counts_of(text: str) -> Counter:
    """What one text adds to the counts. Mentions with the key of a base span are hidden: they count nowhere."""
    total: Counter = Counter()
    nodes = mentions(text, base_spans(text))
    anchors = anchors_of(nodes)
    hidden = [n.label == NONE and any(key in anchors for key in n.keys) for n in nodes]
    for node, unknown in zip(nodes, hidden):
        if not unknown:
            total.update((what, getattr(node, what), str(node.label)) for what in ("shape", "before", "glue"))
    for (i, j), kind in links(nodes).items():
        a, b = nodes[i].label, nodes[j].label
        if kind in ("chain", "alike"):
            if not hidden[i] and not hidden[j]:
                total[kind, str(a), str(b)] += 1
    last: dict[str, int] = {}
    for node in nodes:  # each kind of key by itself: equal digits are equal last digits as well
        for key in node.keys if node.label != NONE else ():
            if key in last:
                total["key", key[0], str(int(last[key] == node.label))] += 1
            last[key] = node.label
    total["shape", "wa", str(NONE)] += len(text.split())  # plain words, which are no nodes by themselves
    return total


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter = Counter()
    for batch in batches:
        for text in batch.column("text").to_pylist():
            if text:
                total.update(counts_of(text))
    rows = [(*key, n) for key, n in total.items()]
    yield pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int64()))],
        ["what", "a", "b", "n"],
    )


def learn(docs: DataFrame, text: str = "text", parts: frozenset[str] = PARTS) -> Field:
    """The field's potentials from all of ``docs``."""
    rows = docs.select(F.col(text).cast("string").alias("text"))
    table = rows.mapInArrow(_counts, "what string, a string, b string, n long").groupBy("what", "a", "b").agg(F.sum("n"))
    return Field({(r[0], r[1], r[2]): r[3] for r in table.collect()}, parts)


def _recovered(field: Field, text: str) -> Iterator[tuple[str, int, int, int, int]]:
    """Every other base span unknown, then the others: ``(kind, n, right, wrong, by look-up)``; mentions that no
    base span covers and that are labelled count as kind ``none``, wrong."""
    nodes = mentions(text, base_spans(text))
    if not nodes:
        return
    for turn in (0, 1):
        known = [n if n.label == NONE or i % 2 == turn else n._replace(label=NONE) for i, n in enumerate(nodes)]
        anchors = anchors_of(known)
        chance, _ = field.judge(known)
        guess = np.where(chance.max(1) >= CERTAIN, chance.argmax(1), NONE)
        for truth, node, got in zip(nodes, known, guess):
            if node.label != NONE:
                continue
            looked_up = any(truth.label in anchors.get(key, {}) for key in node.keys)
            if truth.label != NONE:
                yield KINDS[truth.label], 1, int(got == truth.label), int(got not in (truth.label, NONE)), int(looked_up)
            elif turn and not any(key in anchors for key in node.keys):
                yield "none", 1, int(got == NONE), int(got != NONE), 0


def recover(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """``kind, n, n_right, n_wrong, n_looked_up``: base spans of ``docs`` that the field was not told of, how many of
    them it labels rightly and wrongly, and how many a look-up of the text's other base spans by key
    finds. Kind ``none`` are the mentions without a base span; those labelled are in ``n_wrong``, although
    some may be personal data that no pattern fits. Learn the field from other documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for value in batch.column("text").to_pylist():
                for kind, *n in _recovered(field, value) if value else ():
                    total[kind] = total.get(kind, np.zeros(4, np.int64)) + n
        rows = [pa.array(list(total), pa.string())] + [pa.array([n[i] for n in total.values()], pa.int64()) for i in range(4)]
        yield pa.RecordBatch.from_arrays(rows, ["kind", "n", "n_right", "n_wrong", "n_looked_up"])

    counted = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(
        run, "kind string, n long, n_right long, n_wrong long, n_looked_up long"
    )
    names = ["n", "n_right", "n_wrong", "n_looked_up"]
    return counted.groupBy("kind").agg(*[F.sum(c).alias(c) for c in names])


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def find(docs: DataFrame, field: Field, text: str = "text", out: str = "pii") -> DataFrame:
    """``docs`` with ``out``: counts by kind, the base spans' digest, all ``spans`` as text, ``n_added``, ``settled``."""

    @F.pandas_udf("n_email long, n_ip long, n_card long, n_phone long, n_added long, settled boolean, base_sha256 string, spans string")
    def judge(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for value in texts:
            value = value or ""
            base = base_spans(value)
            added, settled = field.added(value, base)
            n = Counter(kind for _, _, kind in base)
            digest = hashlib.sha256(written(base).encode()).hexdigest()
            every = sorted(base + added, key=lambda s: (s[0], s[2], s[1]))
            rows.append((n[0], n[1], n[2], n[3], len(added), settled, digest, written(every)))
        return pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "n_added", "settled", "base_sha256", "spans"])

    return docs.withColumn(out, judge(F.col(text).cast("string")))
