"""URL filters: rules against a plain reading, aliases against plain reachability."""

import random

from sparkcurate.llm import urls as L


def plain(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    host, tail = rest[:cut].translate(str.maketrans(L.UPPER, L.LOWER)), rest[cut:]
    path = tail[: min([i for i in (tail.find(c) for c in "?#") if i >= 0], default=len(tail))]
    fits = [
        (len(r), r, v) for v, r in L.RULES
        for name, _, start in [r.partition("/")]
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start)
    ]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_rules(spark):
    rng = random.Random(1)
    urls = [None, "", "net/", "://", "http://net", "http://NET/", "a://b://net/x", "http://x.É.net/\n?y", "http://example.net/en"]
    urls += [
        rng.choice(["http", "x"]) + "://" + ".".join(rng.sample(["a", "example", "xnet", "Example"], rng.randrange(3)) + [rng.choice(["net", "com", "org"])])
        + rng.choice(["", "/", "/en/", "/en", "/de/x", "/fr/", "/fr/?q#/de/", "#/en/", "?/fr/"]) for _ in range(300)
    ]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    for r in L.judge(pages).collect():
        host, path, rule, verdict = plain(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule), urls[r.page_id]
        assert r.verdict == verdict or verdict is None


def test_aliases(spark):
    canonical = lambda u: f"<html><link href='{u}' rel=canonical><meta charset=x>"
    refresh = lambda u: f'<META HTTP-EQUIV="refresh" CONTENT="0; URL={u}">'
    pages = [
        (1, "http://a.org/1", canonical("http://b.org/2")), (2, "http://b.org/2", refresh("http://bad.net/")),
        (3, "http://bad.net/", None), (4, "https://a.org/1?utm_source=f#top", None), (5, "http://c.org/", "no tags"),
        (6, "http://d.org/x/y", refresh("/fr/")), (7, "http://d.org/fr/", canonical("http://evil.net/z")), (8, "http://evil.net/z", None),
        (9, "http://d.org/x/y", None), (10, "http://e.org/a/b", canonical("//w.net/q")), (11, None, canonical("http://bad.net/")),
        (1, "http://a.org/1", canonical("http://b.org/2")),
    ]
    df = spark.createDataFrame([(*p, 0) for p in pages], "page_id long, url string, html string, node long")
    got = {r.page_id: (r.verdict, r.rule) for r in L.judge(df).collect()}
    assert got == {
        1: ("block", None), 2: ("block", None), 3: ("block", "net/"), 4: ("block", None), 5: ("allow", None), 6: ("allow", None),
        7: ("allow", "org/fr/"), 8: ("block", "net/"), 9: ("allow", None), 10: ("block", None), 11: ("allow", None),
    }
    assert L.judge(df).count() == 12 and L.judge(df.limit(0)).count() == 0
