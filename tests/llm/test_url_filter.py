"""The URL filter: parts and rules by hand, walks against SQL and whole-number brute force."""

from collections import Counter, defaultdict

import pytest

from lexmill.llm import queries, url_filter

URLS = [
    ("https://A.Example.NET/en/1?x=/", "a.example.net", "/en/1", "example.net/en/", "allow"),
    ("https://example.net/en/", "example.net", "/en/", "example.net/en/", "allow"),
    ("http://example.net/EN/", "example.net", "/EN/", "net/", "block"),
    ("http://net", "net", "", None, "allow"),
    ("http://net?p=/", "net", "", None, "allow"),
    ("x://net#/", "net", "", None, "allow"),
    ("x://net/#a", "net", "/", "net/", "block"),
    ("http://planet/", "planet", "/", None, "allow"),
    ("http://badexample.com/de/", "badexample.com", "/de/", None, "allow"),
    ("http://m.example.com/de/a://b", "m.example.com", "/de/a:", None, None),
    ("http://w.org/fr/x", "w.org", "/fr/x", "org/fr/", "allow"),
    ("no scheme.net/", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("http:///path", "", "/path", None, "allow"),
    ("HTTP://Ü.net:80/\n/", "Ü.net:80", "/\n/", None, "allow"),
    ("http://u.net/" + "long/" * 50_000, "u.net", "/" + "long/" * 50_000, "net/", "block"),
]


def links(*hosts):
    return "".join(f'<p>x <a class=k href="https://{h}/p?q">y</a>' for h in hosts) + '<a href="/own">z</a>'


def graph_pages():
    """Hosts that link to blocked or allowed ones, over one step or two, and one that all link to."""
    pages = [(f"https://farm{i}.test/{k}", links("spam.net", f"FARM{(i + 1) % 4}.test", "hub.test")) for i in range(4) for k in range(5)]
    pages += [("http://spam.net/x", links())] * 60 + [("http://ring.test/", links("spam.net"))] * 9
    pages += [("http://w.org/fr/1", links("good.test", "hub.test", "good.test")), ("http://w.org/fr/2", links("good.test", "spam.net"))] * 4
    pages += [("http://good.test/1", "<A HREF='//better.test'>b</A>"), ("http://better.test/1", "<a href=//good.test/>c</a>"), ("http://lone.test/1", "")]
    pages += [(f"http://leaf{i}.test/", links("hub.test")) for i in range(300)] + [("http://hub.test/", None)] * 2 + [("http://two.test/", links("farm0.test"))] * 3
    pages += [("http://hub.test/", links(*[f"leaf{i}.test" for i in range(300)]))]
    return pages


def table(rows, pages):
    data = [(i, u, h, "net", {"a": 1}) for i, (u, h) in enumerate(pages)] + [(None, "http://lone.test/2", None, None, None)]
    return rows(data, "page_id long, url string, html string, Rule string, bad_host map<string,int>")


def test_parts_and_rules(rows):
    pages = [(u, None) for u, *_ in URLS]
    got = url_filter.filter_urls(table(rows, pages), queries.URL_RULES)
    assert got.columns == ["page_id", "url", "bad_host", "host", "path", "rule", "verdict"]
    by_id = {r["page_id"]: r for r in got.collect()}
    assert len(by_id) == len(URLS) + 1
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        r = by_id[i]
        if verdict is None:
            assert r["host"] == "m.example.com" and r["rule"] == "example.com/de/" and r["verdict"] == "block"
        else:
            assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict), i
    assert url_filter.filter_urls(table(rows, pages).limit(0), queries.URL_RULES).count() == 0


def brute(pages, rounds):
    """Trust and distrust of hosts, round by round over dictionaries."""
    edges, masses = defaultdict(Counter), defaultdict(lambda: [0, 0, 0])
    for r, targets in pages:
        masses[r["host"]][0] += 1
        masses[r["host"]][1] += r["verdict"] == "allow"
        masses[r["host"]][2] += r["verdict"] == "block"
        for t in targets - {r["host"]}:
            edges[r["host"]][t] += 1
            masses[t][0] += 0
    back = defaultdict(Counter)
    for a, out in edges.items():
        for b, n in out.items():
            back[b][a] = n
    unit, shares = url_filter.PAGE_MASS, []
    for out, which in ((edges, 1), (back, 2)):
        walks = []
        for k in (which, 0):
            seed = {h: m[k] * unit for h, m in masses.items()}
            rank = dict(seed)
            for _ in range(rounds):
                after = {h: s - s * 17 // 20 for h, s in seed.items()}
                for h, mass in rank.items():
                    moving, total = mass * 17 // 20, sum(out[h].values())
                    if not total:
                        after[h] += moving
                    for t, n in out[h].items():
                        after[t] += moving * n // total
                rank = after
            walks.append(rank)
        shares.append({h: walks[0][h] / walks[1][h] if walks[1][h] else 0.0 for h in masses})
    return shares


@pytest.mark.parametrize("fan_out", [100_000, 7])
def test_walks_equal_brute_force(rows, monkeypatch, fan_out):
    """Also with the links of a host spread over many keys."""
    monkeypatch.setattr(url_filter, "FAN_OUT", fan_out)
    pages = table(rows, graph_pages())
    judged = url_filter.judged(pages, queries.URL_RULES, "url")
    got = {r["host"]: (r["trust"], r["distrust"]) for r in url_filter.host_ranks(judged, url_filter.host_links(pages, "url", "html"), rounds=6).collect()}
    targets = {}
    for i, (_, h) in enumerate(graph_pages()):
        parts = (h or "").lower().replace("'", '"').replace("href=//", 'href="//').split('href="')[1:]
        targets[i] = {p.split("//")[1].replace(">", '"').replace("/", '"').split('"')[0] for p in parts if "//" in p.split(">")[0] and not p.startswith("/own")}
    known = [(r, targets.get(r["page_id"], set())) for r in judged.collect()]
    trust, distrust = brute(known, 6)
    assert got == {h: (trust[h], distrust[h]) for h in trust}


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_propagated_verdicts(rows, monkeypatch, most):
    """Link farms go, what trusted pages link to stays; broadcast and spread joins agree."""
    monkeypatch.setattr(url_filter, "BROADCAST_HOSTS", most)
    got = url_filter.filter_urls(table(rows, graph_pages()), queries.URL_RULES, threshold=0.2, rounds=6).collect()
    assert len(got) == len(graph_pages()) + 1
    verdicts = defaultdict(set)
    for r in got:
        verdicts[r["host"]].add(r["verdict"])
    assert all(verdicts[h] == {"block"} for h in ("spam.net", "farm0.test", "farm1.test", "farm2.test", "farm3.test", "two.test", "ring.test"))
    assert all(verdicts[h] == {"allow"} for h in ("w.org", "good.test", "better.test", "lone.test", "hub.test", "leaf7.test"))


def test_sql_on_a_graph(rows):
    duckdb = pytest.importorskip("duckdb")
    pages = table(rows, graph_pages()).select("page_id", "url", "html")
    database, arrow = duckdb.connect(), pages.toArrow()
    database.register("pages", arrow)
    want = database.sql(queries.ORACLES["op12_link_graph_url_filter"]).fetchall()
    got = url_filter.filter_urls(pages, queries.URL_RULES).select("page_id", "host", "path", "rule", "verdict").collect()
    assert Counter(map(tuple, got)) == Counter(want) and len({r["verdict"] for r in got if r["rule"] is None}) == 2
