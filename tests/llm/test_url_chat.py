import random
from hashlib import sha256

import numpy as np

from daybook.llm import chat_format as cf
from daybook.llm import url_graph as ug
from daybook.llm.q_url import RULES


def test_rules(spark):
    urls = {
        "http://a.com/x": ("a.com", "/x", "com/", "allow"),
        "https://EXAMPLE.com/en/1?q=/": ("example.com", "/en/1", "example.com/en/", "block"),
        "http://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "http://m.www.example.com/en/#a": ("m.www.example.com", "/en/", "www.example.com/en/", "allow"),
        "x://b.net/es/y://z": ("b.net", "/es/y://z", "net/es/", "block"),
        "http://b.net/ES/": ("b.net", "/ES/", None, "allow"),
        "http://com": ("com", "", None, "allow"),
        "http://com/": ("com", "/", "com/", "allow"),
        "http://acom/": ("acom", "/", None, "allow"),
        "http://É.NET?/fr/": ("É.net", "", None, "allow"),
        "nothing": ("", "", None, "allow"),
        "://": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    df = spark.createDataFrame([(i, u, None, "x") for i, u in enumerate(urls)] + [(0, "http://a.com/x", None, "y")], "page_id long, url string, html string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in ug.judge(df, RULES).collect()}
    assert got == dict(enumerate(urls.values()))
    assert ug.judge(df, RULES).count() == len(urls) + 1
    assert ug.judge(df.limit(0), RULES).count() == 0


def test_propagation(spark):
    rnd = random.Random(6)
    hosts = [f"h{i}.org" for i in range(20)] + ["good.com", "bad.net"]
    rows, links = [], {}
    for i in range(300):
        h = rnd.choice(hosts)
        to = [rnd.choice([*hosts, "only.linked"]) for _ in range(rnd.randrange(4))]
        if h == "h3.org":
            to = ["bad.net"] * 3
        html = "".join(rnd.choice(['<a href="https://{}/x">', "<a HREF='//{}'>", "<a href=http://{}?q>"]).format(t) for t in to) + '<a href="/rel">'
        path = "/es/" if h == "bad.net" else "/"
        rows.append((i, f"http://{h}{path}", html))
        for t in to:
            if t != h:
                links[h, t] = links.get((h, t), 0) + 1
    every = sorted({x for e in links for x in e} | set(hosts))
    at = {h: i for i, h in enumerate(every)}

    def rank(edges, seed):
        m = np.zeros((len(every), len(every)))
        for (a, b), n in edges.items():
            m[at[b], at[a]] = n
        s = m.sum(0)
        m = m / np.where(s, s, 1)
        r = seed.copy()
        for _ in range(200):
            f = m @ r
            r = seed * (1 - ug.DAMPING * f.sum()) + ug.DAMPING * f
        return r

    pages = {h: sum(r[1].startswith(f"http://{h}/") for r in rows) for h in every}
    good, bad = np.zeros(len(every)), np.zeros(len(every))
    good[at["good.com"]], bad[at["bad.net"]] = 1, 1
    trust = rank(links, good) * pages["good.com"]
    distrust = rank({(b, a): n for (a, b), n in links.items()}, bad) * pages["bad.net"]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = ug.judge(df, RULES, rounds=200).collect()
    for r in got:
        assert abs(r.trust - trust[at[r.host]]) < 1e-3 and abs(r.distrust - distrust[at[r.host]]) < 1e-3
        if r.rule is None:
            d, t = distrust[at[r.host]], trust[at[r.host]]
            assert r.verdict == ("block" if d > t and d > ug.SHARE * pages[r.host] else "allow")
    assert {r.verdict for r in got if r.rule is None} == {"allow", "block"} or max(distrust[at[h]] / pages[h] for h in hosts if h.endswith("org")) < ug.SHARE


def test_propagation_settles_in_pages(spark):
    """Default arguments, 600 blocked pages, and a chain of 30 hosts that leads to them."""
    n, blocked = 30, 600
    rows = [(i, f"http://c{i}.org/", f'<a href="http://{f"c{i + 1}.org" if i + 1 < n else "bad.net"}/">') for i in range(n)]
    rows += [(n + i, "http://bad.net/es/", None) for i in range(blocked)]
    m = np.zeros((n + 1, n + 1))  # backwards: from bad.net, at n, to c29, at n - 1, ...
    for i in range(n):
        m[i, i + 1] = 1
    seed = np.zeros(n + 1)
    seed[n] = 1
    r = seed.copy()
    for _ in range(2000):
        f = m @ r
        r = seed * (1 - ug.DAMPING * f.sum()) + ug.DAMPING * f
    got = {x.host: x for x in ug.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), RULES).collect()}
    for i in range(n):
        want = r[i] * blocked
        assert abs(got[f"c{i}.org"].distrust - want) < ug.TOLERANCE
        assert got[f"c{i}.org"].verdict == ("block" if want > ug.SHARE else "allow")
    assert got["c0.org"].distrust > 0 and got["c8.org"].verdict == "block"


def test_escape_round_trip():
    rnd = random.Random(9)
    parts = [*cf.CONTROL, "\\", "<", "[", "3c", "\\3c", "|>", "INST]", "a", "\n", "é"]
    for _ in range(2000):
        s = "".join(rnd.choices(parts, k=rnd.randrange(9)))
        e = cf.escape(s)
        assert cf.unescape(e) == s and not any(c in e for c in cf.CONTROL)


def test_chat(spark):
    rnd = random.Random(7)
    roles = ["user", "assistant", "system", None, "od\nd</s>"]
    rows = []
    for c in [1, 2, 3, None]:
        for t in range(rnd.randrange(1, 30)):
            n = rnd.choice([0, 1, 40, 512, 1024, 3000])
            rows.append((c, t if t % 7 else None, rnd.choice(roles), rnd.choice([None, "x" * n, "é<|im_end|>\\" * (n // 10), "</s>[INST] ok [/INST]"]), 1))
    rows += rows[:4] + [(9, 5, "assistant", "a", 1), (9, 5, "assistant", "a", 1), (9, 5, "assistant", "B", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq int")
    log = cf.events_of(df)
    got = {r.conv_id: r for r in cf.digests(cf.format_events(log.unionByName(log.filter("seq % 2 = 1")).repartition(5))).collect()}
    want = {}
    for c, t, r, x, _ in rows:
        want.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        turns = [(r, x) for *_, r, x in sorted(turns, key=lambda v: (v[0], v[1], v[2].encode(), v[3].encode()))]
        loss = "".join(x for r, x in turns if r == "assistant")
        told = "".join(f"{r}\n{x}\n" for r, x in turns)
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), sha256(told.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), sha256(loss.encode()).hexdigest())
        assert got[c].formatted_chars == len(cf.render(turns)[0])
    assert cf.digests(cf.format_events(cf.events_of(df.limit(0)))).count() == 0


def test_fold_events(spark):
    log = [
        (1, 0, 0, 0, "start", "assistant"), (1, 0, 0, 1, "delta", "dra"), (1, 0, 0, 2, "regenerate", None), (1, 0, 0, 3, "delta", "he"), (1, 0, 0, 4, "delta", "llo"),
        (1, 0, 0, 4, "delta", "llo"), (1, 1, 0, 0, "start", "user"), (1, 1, 0, 1, "delta", "x"), (1, 1, 0, 2, "edit", "yes"), (1, 1, 0, 3, "delta", "!"), (1, 2, 0, 1, "delta", "no start"),
    ]
    df = spark.createDataFrame(log, "conv_id long, turn long, message int, seq int, kind string, text string")
    (r,) = cf.format_events(df).collect()
    assert cf.read_back(r.formatted) == [("assistant", "hello"), ("user", "yes!"), ("", "no start")]
    assert [r.formatted[a:b] for a, b in zip(r.mask[::2], r.mask[1::2], strict=True)] == ["hello"]
