"""Rules and link trust, against a plain computation."""

from __future__ import annotations

from duelframe.llm import urls

PAGE = "page_id long, url string, html string, host string, links long"


def link(*hosts):
    return "".join(f"<a href='http://{h}/x'>y</a>" for h in hosts) + "<a href='/same'>"


def test_rules_and_hosts(spark):
    cases = {
        "http://a.net/x": ("a.net", "/x", "net/", "block"),
        "http://WWW.Example.NET/en/1?q": ("www.example.net", "/en/1", "example.net/en/", "allow"),
        "https://example.net/fr/1": ("example.net", "/fr/1", "net/", "block"),
        "http://sub.example.com/de/": ("sub.example.com", "/de/", "example.com/de/", "block"),
        "http://notexample.com/de/": ("notexample.com", "/de/", None, "allow"),
        "http://x.org/fr/#t": ("x.org", "/fr/", "org/fr/", "allow"),
        "http://a.net": ("a.net", "", None, "allow"),
        "http://a://b/c": ("a:", "//b/c", None, "allow"),
        "no url": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        "x://": ("", "", None, "allow"),
        "HTTP://É.ORG?a/b": ("É.org", "", None, "allow"),
    }
    rows = [(i, u, None, "clash", 1) for i, u in enumerate(cases)] + [(99, None, "", "clash", 1), (99, None, "", "clash", 1)]
    got = urls.judge(spark.createDataFrame(rows, PAGE), min_lift=1e9)
    assert got.count() == len(rows)
    found = {r["url"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got.collect()}
    assert found.pop(None) == ("", "", None, "allow")
    assert found == cases
    assert urls.judge(spark.createDataFrame([], PAGE)).count() == 0


def brute_ranks(pages, rounds):
    """Hosts, and their trust and distrust after so many rounds."""
    hosts, good, bad, links = {}, {}, {}, {}
    for host, verdict, to in pages:
        hosts[host] = hosts.get(host, 0) + 1
        good[host] = good.get(host, 0) + (verdict == "allow")
        bad[host] = bad.get(host, 0) + (verdict == "block")
        for t in set(to) - {host}:
            links[host, t] = links.get((host, t), 0) + 1
            hosts.setdefault(t, 0)
    seed = [{h: s.get(h, 0) / max(sum(s.values()), 1) for h in hosts} for s in (good, bad)]
    out, into = {}, {}
    for (s, d), n in links.items():
        out[s] = out.get(s, 0) + n
        into[d] = into.get(d, 0) + n
    ranks = [{h: 0.15 * v for h, v in s.items()} for s in seed]
    for _ in range(rounds):
        new = [{h: 0.15 * v for h, v in s.items()} for s in seed]
        for (s, d), n in links.items():
            new[0][d] += 0.85 * ranks[0][s] * n / out[s]
            new[1][s] += 0.85 * ranks[1][d] * n / into[d]
        ranks = new
    return hosts, ranks


def test_distrust_flows_backwards_and_trust_forwards(spark):
    plan = [
        ("bad.net", ["spam.com"]), ("bad.net", []), ("spam.com", ["bad.net", "worse.net"]), ("spam.com", ["bad.net"]), ("worse.net", []),
        ("good.org", ["fine.com"]), ("fine.com", ["plain.com"]), ("plain.com", ["unseen.com"]), ("feeder.com", ["spam.com"]), *[("quiet.com", [])] * 10,
    ]
    path = {"good.org": "/fr/"}
    rows = [(i, f"http://{h}{path.get(h, '/p')}", link(*to), "x", 0) for i, (h, to) in enumerate(plan)]
    got = {r["host"]: r["verdict"] for r in urls.judge(spark.createDataFrame(rows, PAGE)).collect()}
    says = {"bad.net": "block", "worse.net": "block", "good.org": "allow"}
    hosts, (trust, distrust) = brute_ranks([(h, says.get(h), to) for h, to in plan], urls.ROUNDS)
    total = sum(hosts.values())
    want = {h: says.get(h) or ("block" if distrust[h] > trust[h] and distrust[h] > n / total else "allow") for h, n in hosts.items() if n}
    assert got == want
    assert got["spam.com"] == "block" and got["fine.com"] == got["plain.com"] == got["quiet.com"] == "allow"
