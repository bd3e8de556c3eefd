"""The URL filter: rules, the spread of trust and distrust, odd rows, and its SQL on a graph with links."""

from __future__ import annotations

import duckdb
import pytest

from subtide.llm import link_graph, oracles
from subtide.llm.queries import URL_RULES

SCHEMA = "page_id long, url string, html string, host string, verdict string, n int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", None, 7) for r in rows], SCHEMA).repartition(3)


def judged(spark, rows, rules=URL_RULES):
    found = link_graph.filter_urls(table(spark, rows), link_graph.rule_table(spark, rules)).collect()
    return sorted((tuple(r) for r in found), key=repr)


def by_sql(rows):
    connection = duckdb.connect()
    connection.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    connection.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    return sorted(connection.execute(f"SELECT page_id, host, path, rule, verdict FROM ({oracles.URLS})").fetchall(), key=repr)


def by_host(found):
    return {r[1]: r[4] for r in found}


def linked(*hosts):
    return " ".join(f'<a href="http://{h}/x">x</a>' for h in hosts)


ROWS = [
    (1, "http://Sub.Example.NET/en/1?x=1", linked("hub.io", "HUB.io", "sub.example.net")),
    (2, "http://sub.example.net/EN/1#t", "<a HREF = '//spam.io:80/'>"),
    (3, "https://net/", None),
    (4, "https://net", "<img src=https://spam.io/a.png>"),
    (5, "ftp://notnet/", linked("spam.net", "spam.net", "good.org")),
    (6, "x://a.example.com/de", linked("hub.io")),
    (7, "x://a.example.com/de/?u=http://b.net/", ""),
    (8, "x://good.org/fr/", linked("hub.io", "friend.io")),
    (9, "x://friend.io/fr/", linked("good.org")),
    (10, "x://farm.io/", linked("spam.net", "spam.net", "spam.net")),
    (11, "x://hub.io/?a", linked("friend.io", "spam.net")),
    (12, None, linked("spam.net")),
    (13, "no scheme.net/", linked("spam.net")),
    (13, "no scheme.net/", linked("spam.net")),
    (14, "://", "href=//nobody"),
    (15, "", None),
    (16, "http://spam.net/\nen/", linked(*["a" * 300 + f"{i}.io" for i in range(50)])),
    (16, "http://spam.net/\nen/", linked(*["a" * 300 + f"{i}.io" for i in range(50)])),
    (None, "http://" + "a." * 5000 + "net/fr/é😀", "x" * 200_000 + linked("hub.io") * 2000),
    (18, "http://" + "n" * 100_000, "<" * 100_000),
    (19, "http://ÄB.org/fr/", linked("ÄB.org")),
]


def test_rules_and_graph_against_sql(spark):
    found = judged(spark, ROWS)
    assert found == by_sql(ROWS)
    of = {r[0]: r[1:] for r in found}
    assert of[1] == ("sub.example.net", "/en/1", "example.net/en/", "allow")
    assert of[2][2:] == ("net/", "block") and of[3][2:] == ("net/", "block")
    assert of[4] == ("net", "", None, "block")  # its only ruled page is blocked, and so is half of the host
    assert of[6][2] is None and of[7][2:] == ("example.com/de/", "block")
    assert of[8][2:] == ("org/fr/", "allow") and of[19][:3] == ("Äb.org", "/fr/", "org/fr/")
    assert of[12] == ("", "", None, "allow") and of[13] == ("", "", None, "allow") and of[14] == ("", "", None, "allow")


def test_distrust_goes_against_links_and_trust_along_them(spark):
    rows = [
        (1, "x://spam.net/", ""),
        (2, "x://farm.io/", linked("spam.net")),
        (3, "x://farm2.io/", linked("farm.io")),
        (4, "x://good.org/fr/", linked("friend.io", "both.io")),
        (5, "x://friend.io/", ""),
        (6, "x://both.io/", linked("spam.net", "friend.io")),
        (7, "x://alone.io/", linked("friend.io")),
    ]
    assert judged(spark, rows) == by_sql(rows)
    pages = table(spark, rows)
    first = link_graph.by_rules(pages, link_graph.rule_table(spark, URL_RULES))
    scores = {r.host: r for r in link_graph.host_scores(first, link_graph.arcs(link_graph.links(pages))).collect()}
    assert scores["spam.net"].distrust == 1 == scores["good.org"].trust
    # spam.net answers to two hosts, so each gets 0.85 / 2 of its page.
    assert scores["farm.io"].distrust == pytest.approx(0.425 / 1.425, abs=1e-5)
    assert scores["farm2.io"].distrust == pytest.approx(0.425 * 0.85 / (1.425 * 0.85 + 1), abs=1e-5)
    assert scores["both.io"].distrust > 0 == scores["alone.io"].distrust
    assert scores["friend.io"].trust > 0 == scores["farm.io"].trust
    assert {r[1]: r[4] for r in judged(spark, rows)} == {**dict.fromkeys(scores, "allow"), "spam.net": "block"}
    # A host that links to a large blocked one and has little of its own goes with it.
    rows += [(10 + i, "x://spam.net/", "") for i in range(20)]
    verdicts = {r[1]: r[4] for r in judged(spark, rows)}
    assert verdicts == by_host(by_sql(rows)) and {h for h, v in verdicts.items() if v == "block"} == {"spam.net", "farm.io", "farm2.io", "both.io"}


def test_scores_against_direct_rounds(spark):
    """The same sums by floating point over a random graph with a hub that has a third of all links."""
    import random

    draw = random.Random(3)
    hosts = [f"h{i}.{draw.choice(['net', 'org', 'io'])}" for i in range(40)]
    rows = []
    for i in range(400):
        targets = ["h0." + hosts[0].split(".")[1], *draw.sample(hosts, 2)]
        rows.append((i, f"x://{draw.choice(hosts)}{draw.choice(['/fr/', '/', ''])}", linked(*targets)))
    assert judged(spark, rows) == by_sql(rows)
    pages = table(spark, rows)
    first = link_graph.by_rules(pages, link_graph.rule_table(spark, URL_RULES))
    edges = link_graph.links(pages)
    scores = {r.host: (r.trust, r.distrust) for r in link_graph.host_scores(first, link_graph.arcs(edges)).collect()}
    weights = {(r.src, r.dst): r.w for r in edges.collect()}
    pages_of, allowed, blocked = {}, {}, {}
    for r in first.collect():
        pages_of[r.host] = pages_of.get(r.host, 0) + 1
        allowed[r.host] = allowed.get(r.host, 0) + (r.verdict == "allow")
        blocked[r.host] = blocked.get(r.host, 0) + (r.verdict == "block")

    def rank(start, arcs):
        out, total, flow = {}, dict(start), dict(start)
        for (s, _), w in arcs.items():
            out[s] = out.get(s, 0) + w
        for _ in range(link_graph.ROUNDS):
            came = {}
            for (s, d), w in arcs.items():
                came[d] = came.get(d, 0) + flow.get(s, 0) * 0.85 * w / out[s]
            flow = came
            for h, f in flow.items():
                total[h] = total.get(h, 0) + f
        return total

    back = {(d, s): w for (s, d), w in weights.items()}
    trust, all_on, distrust, all_back = rank(allowed, weights), rank(pages_of, weights), rank(blocked, back), rank(pages_of, back)
    assert set(scores) == set(pages_of)
    for h, (t, d) in scores.items():
        assert t == pytest.approx(trust[h] / all_on[h], abs=1e-4) and d == pytest.approx(distrust[h] / all_back[h], abs=1e-4)


def test_no_pages_and_no_rules(spark):
    assert judged(spark, []) == []
    assert {r[3:] for r in judged(spark, ROWS, rules=[])} == {(None, "allow")}


def test_main_path_has_no_python_worker(spark):
    found = link_graph.filter_urls(table(spark, ROWS), link_graph.rule_table(spark, URL_RULES))
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
