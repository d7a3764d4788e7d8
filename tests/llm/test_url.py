import pytest

from cohortweave.llm import url_reputation as ur
from cohortweave.llm.url_reputation import UrlRule

URLS = {
    "http://a.com/x": ("a.com", "/x", "com/", "allow"),
    "http://a.com": ("a.com", "", None, "allow"),
    "https://sub.Example.COM/en/1?q=/en/#t": ("sub.example.com", "/en/1", "example.com/en/", "block"),
    "https://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
    "https://m.www.example.com/en/x": ("m.www.example.com", "/en/x", "www.example.com/en/", "allow"),
    "https://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
    "http://x.net/es/1": ("x.net", "/es/1", "net/es/", "block"),
    "http://x.net/es": ("x.net", "/es", None, "allow"),
    "http://net/fr/#f": ("net", "/fr/", "net/fr/", "block"),
    "http://h.org?x=/a/b": ("h.org", "", None, "allow"),
    "ftp://É.de/ü/%20://": ("É.de", "/ü/%20://", None, "allow"),
    "no scheme": ("", "", None, "allow"),
    "": ("", "", None, "allow"),
    "://": ("", "", None, "allow"),
    None: ("", "", None, "allow"),
}


def brute_strength(groups):
    alone = sum(m * (1 - m) for n, _, m in groups if n)
    together = sum(m * (1 - m) * (n - 1) for n, _, m in groups if n)
    spread = sum((b - n * m) ** 2 / n for n, b, m in groups if n)
    c = (spread - alone) / together if together else 0.5
    return 1 / min(max(c, 0.001), 0.5) - 1


def test_rules(frame):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(None, "http://x.net/es/1"), (0, "http://a.com/x")]
    pages = frame("page_id long, url string", rows)
    found = ur.judge(pages, frame("page_id long, is_bad boolean", [])).collect()
    wanted = [(i, *URLS[u]) for i, u in rows]
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, wanted))


def test_longest_rule_wins_whatever_the_order(frame):
    rules = [UrlRule("block", "a.com/x/y"), UrlRule("allow", "a.com/x"), UrlRule("block", "a.com/")]
    pages = frame("page_id long, url string", [(1, "s://b.a.com/x/yz"), (2, "s://a.com/xz"), (3, "s://a.com/z")])
    for order in (rules, rules[::-1]):
        found = ur.judge(pages, frame("page_id long, is_bad boolean", []), order).collect()
        assert {(r.page_id, r.rule) for r in found} == {(1, "a.com/x/y"), (2, "a.com/x"), (3, "a.com/")}


@pytest.mark.parametrize(
    "host, domain, suffix",
    [("a.b.example.org", "example.org", "org"), ("x.co.uk:80", "x.co.uk", "co.uk"), ("localhost", "localhost", ""),
     ("", "", ""), ("co.uk", "co.uk", "")],
)
def test_registered_domain(frame, host, domain, suffix):
    df = frame("h string", [(host,)])
    assert tuple(df.select(*ur.domain_and_suffix(df["h"])).first()) == (domain, suffix)


def test_reputation_shrinks_by_levels(frame):
    counts = {"bad.farm.org": (40, 38), "new.farm.org": (0, 0), "ok.site.org": (50, 1), "one.site.org": (1, 1), "c.com": (9, 0)}
    rows = [(h, i < bad) for h, (n, bad) in counts.items() for i in range(n)] + [("new.farm.org", None)]
    got = {r.host: r for r in ur.host_reputation(frame("host string, is_bad boolean", rows)).collect()}
    total, bad = 100, 40
    top = (bad + 1) / (total + 2)
    suffix = {"org": (91, 40), "com": (9, 0)}
    k1 = brute_strength([(*v, top) for v in suffix.values()])
    mean_s = {s: (b + k1 * top) / (n + k1) for s, (n, b) in suffix.items()}
    domain = {"farm.org": (40, 38), "site.org": (51, 2), "c.com": (9, 0)}
    k2 = brute_strength([(*v, mean_s[d.split(".")[1]]) for d, v in domain.items()])
    mean_d = {d: (b + k2 * mean_s[d.split(".")[1]]) / (n + k2) for d, (n, b) in domain.items()}
    of = {h: h if h == "c.com" else h.split(".", 1)[1] for h in counts}
    k3 = brute_strength([(n, b, mean_d[of[h]]) for h, (n, b) in counts.items()])
    for h, (n, b) in counts.items():
        mean = (b + k3 * mean_d[of[h]]) / (n + k3)
        bound = mean - 1.645 * (mean * (1 - mean) / (n + k3 + 1)) ** 0.5
        assert got[h].n == n and abs(got[h].mean - mean) < 1e-5 and abs(got[h].bound - bound) < 1e-5
    assert got["bad.farm.org"].bound > 0.5 > got["one.site.org"].bound


def test_bad_host_is_blocked_and_clashing_columns(frame):
    pages = [(i, f"http://bad.farm.org/{i}", "h", "v") for i in range(40)]
    pages += [(100 + i, f"http://ok{i % 9}.site.org/{i}", "h", "v") for i in range(60)]
    outcomes = [(i, i < 39) for i in range(40)] + [(100 + i, False) for i in range(50)] + [(None, True), (7, None)]
    found = ur.judge(
        frame("page_id long, url string, host string, verdict string", pages),
        frame("page_id long, is_bad boolean", outcomes),
    ).collect()
    assert {r.verdict for r in found if r.host == "bad.farm.org"} == {"block"}
    assert {r.verdict for r in found if r.host != "bad.farm.org"} == {"allow"}
    assert len(found) == 100
