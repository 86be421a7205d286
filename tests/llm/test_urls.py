"""URL rules and host trust against plain versions."""

from __future__ import annotations

import re

from docframe.llm import url_filter as uf
from tests.llm.conftest import SF

ODD = [
    (1, "http://Example.COM/en/x?y#z", None), (2, "https://www.example.com/en/1", ""), (3, "https://sub.www.example.com/en/1", "<p>"), (4, "http://a.net/es/1", None),
    (5, "http://a.net/es", None), (6, "net/es/", None), (7, None, None), (8, "http://", "x"), (9, "x://b.org?://c.com/", None), (10, "http://notnet/es/", None),
    (11, "http://net/fr/", None), (12, "http://com", None), (13, "http://com/", None), (14, "ftp://user@h.com:80/p/q", None), (14, "ftp://user@h.com:80/p/q", None), (None, "http://é.ÉCOLE.org/\n?", None),
]


def plain(url):
    if not url or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in uf.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, None))
    return host, path, best[1], best[2]


def pagerank(edges, seeds, nodes):
    out = {}
    for (s, _), n in edges.items():
        out[s] = out.get(s, 0) + n
    score = dict.fromkeys(nodes, 0.0) | seeds
    for _ in range(uf.ROUNDS):
        new = {h: (1 - uf.DAMPING) * seeds.get(h, 0.0) for h in nodes}
        for (s, d), n in edges.items():
            new[d] += uf.DAMPING * score[s] * n / out[s]
        score = new
    return score


def whole(pages):
    ruled = [(p, *plain(u)) for p, u, _ in pages]
    good, bad, edges, nodes = {}, {}, {}, set()
    for (_, _, html), (_, host, _, _, verdict) in zip(pages, ruled):
        if host:
            nodes.add(host)
            side = {"allow": good, "block": bad}.get(verdict)
            if side is not None:
                side[host] = side.get(host, 0) + 1
            for dst in re.findall(uf.LINK, html or ""):
                dst = dst.lower()
                if dst != host:
                    edges[host, dst] = edges.get((host, dst), 0) + 1
    for host in set(nodes):
        parent = re.sub(r"^[^.]*\.", "", host)
        if parent != host and "." in parent:
            edges[host, parent] = edges.get((host, parent), 0) + 1
    nodes |= {h for e in edges for h in e}
    share = lambda x: {h: n / sum(x.values()) for h, n in x.items()}
    trust = pagerank(edges, share(good), nodes)
    distrust = pagerank({(d, s): n for (s, d), n in edges.items()}, share(bad), nodes)
    blocked = {h for h in nodes if distrust[h] > uf.RATIO * trust[h] + uf.FLOOR / len(nodes)}
    return [(p, h, path, rule, v or ("block" if h in blocked else "allow")) for p, h, path, rule, v in ruled]


def compare(df, pages):
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, df.collect()), key=key) == sorted(whole(pages), key=key)


def test_odd_urls(spark):
    compare(uf.judge_urls(spark.createDataFrame(ODD, "page_id long, url string, html string")), ODD)
    assert uf.judge_urls(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_real_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    compare(uf.judge_urls(pages), [tuple(r) for r in pages.collect()])


def test_distrust_reaches_hosts_that_link_to_a_blocked_one(spark):
    pages = [(i, "http://bad.net/es/1", "") for i in range(50)] + [(100, "http://farm.org/1", '<a href="http://bad.net/es/1">'), (101, "http://good.org/1", "<a href='http://fine.com/'>")]
    pages += [(200 + i, "http://fine.com/1", "") for i in range(50)]
    got = {r["page_id"]: r["verdict"] for r in uf.judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[100] == "block" and got[101] == "allow" and got[0] == "block" and got[200] == "allow"
