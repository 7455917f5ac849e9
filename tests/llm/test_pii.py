"""Personal data: base spans against the plain patterns, what the field adds, edge cases."""

import random
import re
from collections import Counter

import numpy as np

from sparkcurate.llm import pii as P

PATTERNS = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
)


def passes(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        total = sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits)))
        return 14 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def plain(text):
    spans = [
        (m.start(), i, m.end(), kind) for i, (kind, p) in enumerate(PATTERNS) for m in p.finditer(text) if passes(kind, m[0])
    ]
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(spans))


def test_base_spans_equal_the_patterns():
    rng = random.Random(1)
    for _ in range(20_000):
        text = "".join(rng.choice("ab@.+-1234 567()%é") for _ in range(rng.randrange(60)))
        assert P.written(P.base_spans(text)) == plain(text), text


def test_marginals_equal_enumeration_on_a_tree():
    rng = np.random.default_rng(1)
    own, edges = rng.normal(size=(4, 3)), np.array([[0, 1], [1, 2], [1, 3]])
    pair = rng.normal(size=(3, 3, 3))
    want = np.zeros((4, 3))
    for x in np.ndindex(3, 3, 3, 3):
        w = np.exp(sum(own[i, x[i]] for i in range(4)) + sum(pair[k, x[a], x[b]] for k, (a, b) in enumerate(edges)))
        for i in range(4):
            want[i, x[i]] += w
    assert np.allclose(P.infer(own, edges, pair, rounds=200)[0], want / want.sum(1, keepdims=True), atol=1e-4)


NUMBERS = [f"{(7919 * i) % 900 + 100} {(31 * i) % 900 + 100} {(17 * i) % 9000 + 1000}" for i in range(400)]


def corpus():
    """Phones behind "call", names of addresses, numbers that are no one's, and plain words."""
    texts = [f"please call +1 {n} now" for n in NUMBERS[:150]]
    texts += [f"write to anna.k{i}@example.org soon and then more words" for i in range(150)]
    texts += [f"order {7_000_000 + 13 * i} shipped, ref 8{i:06d}00 paid" for i in range(150)]
    texts += [f"id x{40_000_000 + 7 * i}y and see part-{i}b.txt" for i in range(60)]
    # One shape, told apart by the word before only.
    texts += [f"fax +49 30 {1000 + i} {2000 + i} and lot 55 {1000 + i} {2000 + i}" for i in range(100)]
    return texts


def counted(texts, parts=P.PARTS):
    total = sum(map(P.counts_of, texts), Counter())
    return P.Field(total, parts)


def labelled(field, text):
    return {text[a:b]: P.KINDS[k] for a, b, k in field.added(text, P.base_spans(text))[0]}


def test_every_part_of_the_field_has_a_say():
    every = counted(corpus())
    # Own shape: a phone without its plus sign, in a text without any base span.
    assert labelled(every, "then call 743 555 3824 or order 8891234") == {"743 555 3824": "phone"}
    assert labelled(counted(corpus(), P.PARTS - {"shape"}), "they 743 555 3824 or order 8891234") == {}
    # The word before: the same shape behind "fax" and behind "lot".
    assert labelled(every, "fax 30 4711 8122, but lot 30 4711 8133") == {"30 4711 8122": "phone"}
    assert labelled(counted(corpus(), P.PARTS - {"before"}), "fax 30 4711 8122") == {}
    # A link to a base span with the same digits, in another shape.
    repeats = [f"+1 {n} or +1 {n}" for n in NUMBERS[200:400]]
    far = "+1 743 555 3824 rang; it was 7435553824 again"
    assert labelled(counted(corpus() + repeats), far) == {"7435553824": "phone"}
    assert labelled(counted(corpus() + repeats, P.PARTS - {"key"}), far) == {}


def test_links_of_mentions_that_look_alike_add_up():
    """Neighbours with one shape and one word before share what they are, without a common key."""
    texts = [f"dial +1 {a}, dial +1 {b}, dial +1 {c}" for a, b, c in zip(NUMBERS, NUMBERS[100:], NUMBERS[200:])]
    texts += [f"dial {a}, dial {b}, dial {c}" for a, b, c in zip(NUMBERS[50:], NUMBERS[150:], NUMBERS[250:])]
    field, off = counted(texts), counted(texts, P.PARTS - {"alike", "chain"})
    text = "dial +1 743 555 3824, dial 201 555 1234, dial 202 555 1235"
    assert set(labelled(field, text).values()) == {"phone"} and len(labelled(field, text)) == 2
    assert labelled(off, text) == {}  # by itself each is as likely none as a phone


def test_repeats_of_a_text_without_base_spans_can_be_labelled():
    texts = corpus() + [f"+1 {n} or +1 {n}" for n in NUMBERS[200:400]] + [f"code {n}" for n in NUMBERS[:60]]
    field = counted(texts)
    one, many = "743 555 3824", "743 555 3824; " * 6
    nodes = lambda text: field.judge(P.mentions(text, []))[0][:, 3]
    assert nodes(many).min() > nodes(one)[0]


def test_hidden_base_spans_are_recovered_better_than_by_look_up(spark):
    texts = corpus() + [f"+1 {n} or +1 {n}" for n in NUMBERS[200:300]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    field = P.learn(docs.filter("doc_id % 5 > 0"))
    assert field.agree == counted([t for i, t in enumerate(texts) if i % 5]).agree
    found = {r.kind: r for r in P.recover(docs.filter("doc_id % 5 = 0"), field).collect()}
    for kind in ("phone", "email"):
        assert found[kind].n_right >= 0.95 * found[kind].n and found[kind].n_wrong == 0
        assert found[kind].n_looked_up < 0.7 * found[kind].n
    assert found["none"].n_wrong <= 0.05 * found["none"].n


def test_field_on_a_table_and_odd_rows(spark, edges, none):
    again = "Call +1 (743) 555-3824 now. Later: 743 555 3824 was busy, order 8891234 came."
    rows = list(enumerate([again, "order 8891234", None, *corpus()]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.pii for r in P.find(docs, P.learn(docs)).collect()}
    start = again.index("743 555 3824")
    assert found[0].n_phone == 1 and found[0].n_added == 1 and f"phone:{start}:{start + 12}" in found[0].spans
    assert found[1].spans == "" and found[2].spans == "" and found[2].n_email == 0 and all(r.settled for r in found.values())
    out = P.find(edges, P.learn(edges))
    assert out.count() == edges.count() and P.find(none, P.learn(none)).count() == 0


def test_a_large_corpus_does_not_outvote_a_link():
    """Rare labels: thousands of numbers of the same shape that are no one's, a million plain words."""
    noise = [f"number {7_000_000_000 + 7919 * i} and {1_000_000 + 13 * i}" for i in range(3_000)]
    noise += [f"person{i}x@example.org wrote, then person{i}x left" for i in range(500)] + ["plain words " * 500_000]
    repeats = [f"+1 {n} or +1 {n}" for n in NUMBERS] + [f"a.b{i}@example.org, a.b{i}@example.org" for i in range(400)]
    field = counted(corpus() + noise + repeats)
    assert labelled(field, "+1 (743) 555-3824; later 7435553824") == {"7435553824": "phone"}
    text = "Write to rosalind.k@example.org today. It was rosalind.k who asked, not someone else."
    assert labelled(field, text) == {"rosalind.k": "email"}
    assert labelled(field, "number 7435553824") == {}


def test_every_repeat_is_labelled_however_many():
    repeats = [f"+1 {n} or +1 {n}" for n in NUMBERS] + [f"a.b{i}@example.org, a.b{i}@example.org" for i in range(400)]
    field = counted(corpus() + repeats)
    for n in (1, 5, 100, 500):
        for base, again, kind in (("+1 (743) 555-3824", "743 555 3824", 3), ("rosalind.k@example.org", "Rosalind.k", 0)):
            for head, tail in ((0, n), (n, 0), (n // 2, n - n // 2)):  # the base span first, last, between
                text = f"{again}; 8891234, 8891234, " * head + base + f"; {again}, 8891234" * tail
                want = {m.span() for m in re.finditer(re.escape(again), text)}
                added, settled = field.added(text, P.base_spans(text))
                assert settled and len(want) == n and {(a, b) for a, b, k in added if k == kind} == want and len(added) == n
                assert len(P.links(P.mentions(text, P.base_spans(text)))) <= 4 * (3 * n + 1)
