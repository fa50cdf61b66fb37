"""URL lists: intervals, as-of evaluation against a replay of the entries, odd input."""

import datetime as dt
import random

from kinlink.llm import op06_lists as m

DAY = dt.date(2024, 1, 1)


def replay(entries, host, fetched):
    """Lists active for a host on a day, by playing the entries in order."""
    state = {}
    for name, domain, on, action in sorted(entries, key=lambda e: (e[2], e[3])):
        if on <= fetched and (host == domain or host.endswith("." + domain)):
            state[(name, domain)] = action == "add"
    return ",".join(sorted({k[0] for k, v in state.items() if v}))


def test_random_histories(spark):
    rng = random.Random(4)
    names = ["a.com", "x.a.com", "b.org", "com", "y.x.a.com"]
    entries = [(rng.choice(["l1", "l2"]), rng.choice(names[:4]), DAY + dt.timedelta(rng.randrange(30)), rng.choice(["add", "remove"])) for _ in range(60)]
    captures = [(k, f"http://{rng.choice(names)}/p", DAY + dt.timedelta(rng.randrange(35))) for k in range(300)]
    e = spark.createDataFrame(entries, "list string, domain string, on date, action string")
    c = spark.createDataFrame(captures, "id long, url string, fetched date")
    got = {r["id"]: (r["lists"], r["blocked"]) for r in m.judged(c, e).collect()}
    for k, url, fetched in captures:
        want = replay(entries, url.split("/")[2], fetched)
        assert got[k] == (want, want != "")


def test_odd_captures_and_entries(spark):
    e = spark.createDataFrame([("l", "A.com", DAY, "add"), ("l", None, DAY, "add"), (None, "b.com", DAY, "add"), ("l", "c.com", None, "add"), ("l", "d.com", DAY, "other")], "list string, domain string, on date, action string")
    rows = [(1, "HTTP://user@A.COM.:80/x", DAY), (2, None, DAY), (3, "no url", DAY), (4, "http://a.com", None), (5, "http://nota.com/", DAY), (6, "http://b.com", DAY), (7, "http://c.com", DAY), (8, "http://d.com", DAY), (1, "HTTP://user@A.COM.:80/x", DAY), (None, "http://s.a.com#f", DAY)]
    c = spark.createDataFrame([(*r, "z") for r in rows], "id long, url string, fetched date, domain string")
    got = sorted((str(r["id"]), r["blocked"]) for r in m.judged(c, e).collect())
    assert got == sorted([("1", True), ("1", True), ("2", False), ("3", False), ("4", False), ("5", False), ("6", False), ("7", False), ("8", False), ("None", True)])
    assert m.judged(c.limit(0), e).count() == 0
    assert m.judged(c, e.limit(0)).filter("blocked").count() == 0


def test_domains_and_hosts_are_written_alike(spark):
    names = ["A.com.", "b.org:80", " http://user@C.net:8080/x ", ".d.de", "[2001:DB8::1]", "", ".", "e.com/path"]
    e = spark.createDataFrame([("l", n, DAY, "add") for n in names], "list string, domain string, on date, action string")
    urls = ["http://a.com/", "http://x.b.org/", "https://c.net", "http://d.de", "http://[2001:db8::1]:80/x", "http://e.com", "http://[2001:db8::2]/", "http://f.com"]
    c = spark.createDataFrame([(k, u, DAY) for k, u in enumerate(urls)], "id long, url string, fetched date")
    assert {r["id"]: r["blocked"] for r in m.judged(c, e).collect()} == {k: k < 6 for k in range(8)}
