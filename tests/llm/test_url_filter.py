"""URL filter: rules, shapes, merged templates and purity, against a plain reading."""

import random
import re
import time

from leadflow.llm import url_filter as U
from pyspark.sql import functions as F

SCHEMA = "page_id long, url string, host string, path string, verdict string, n string, shape string"


def plain(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(len(d + p), d + p, v) for d, p, v in U.RULES if (host == d or host.endswith("." + d)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


URLS = ["http://a.example.net/en/1", "https://EXAMPLE.net/en/", "http://example.net/en", "http://net/", "http://net", "http://xnet/a",
        "http://example.com/de/1?x=1", "http://www.example.com/de", "http://a.org/fr/x#y", "http://a.org/en/x", "no url", "", None,
        "://h/p", "http://É.Org/fr/É", "http://h?q=http://example.net/", "http://a.net#frag/x", "ftp://u@b.net:80/x/y",
        "a://b\n.net/fr/\n1", "http://h/" + "seg/" * 60]


def pages(spark, urls):
    return spark.createDataFrame([(i, u, *"abcde") for i, u in enumerate(urls)], SCHEMA)


def test_rules(spark):
    out = {r.page_id: r for r in U.judge_urls(pages(spark, URLS + URLS[:3])).collect()}
    assert len(out) == len(URLS) + 3
    for i, u in enumerate(URLS):
        host, path, rule, verdict = plain(u)
        assert (out[i].host, out[i].path, out[i].rule) == (host, path, rule), u
        assert out[i].verdict == (verdict or "allow"), u
    assert U.judge_urls(pages(spark, [])).collect() == []


def test_templates_are_rejected_by_purity(spark):
    rows = [("h", f"/spam/{i}", "block" if i < 25 else None) for i in range(60)]
    rows += [("h", f"/news/{i}", "allow") for i in range(30)]
    rows += [("h", f"/win/{i}", "block") for i in range(25)] + [("h", f"/new/{i}", None) for i in range(40)]
    rows += [("g", f"/user-{chr(97 + i % 26)}{chr(97 + i // 26)}/x", "block" if i % 3 else "allow") for i in range(200)]
    df = spark.createDataFrame(rows, "host string, path string, label string")
    out = {r["shape"]: r for r in U.template_verdicts(df).collect()}
    assert out["h/spam/{n}"].template == out["h/win/{n}"].template == "h/spam|win/{n}"       # similar branches are one
    assert out["h/spam/{n}"].method == "block" and abs(out["h/spam/{n}"].purity - 51 / 52) < 1e-9
    assert out["h/news/{n}"].method == "allow" and out["h/news/{n}"].template == "h/news/{n}"
    assert (out["h/new/{n}"].purity, out["h/new/{n}"].method) == (0.5, "allow")         # nothing is known of it
    assert {r.template for s, r in out.items() if s.startswith("g/")} == {"g/*/x"}     # many rare children
    assert sum(r.n for r in out.values()) == len(rows)


def test_shapes(spark):
    got = spark.range(1).select(U.path_shape(F.lit("//a/12/page-7.html/0123456789abcdef0123/x/")).alias("s")).first().s
    assert list(got) == ["a", "{n}", "page-{n}.html", "{x}", "x"]


def brute_templates(rows, reject=0.9):
    """The whole method in plain Python: (shape -> template, purity, verdict)."""
    def shape(path):
        return tuple(re.sub(r"\d+", "{n}", re.sub(r"^[0-9a-fA-F-]*[0-9][0-9a-fA-F-]{15,}", "{x}", s)) for s in path.replace("|", "%7C").replace("*", "%2A").split("/") if s)
    stats = {}
    for host, path, label in rows:
        s = stats.setdefault((host, shape(path)), [0, 0, 0])
        s[0] += 1
        s[1] += label == "block"
        s[2] += label is not None
    now = {k: k[1] for k in stats}
    for depth in range(max((len(k[1]) for k in stats), default=0)):
        parents = {}
        for k, segs in now.items():
            if len(segs) > depth:
                c = parents.setdefault((k[0], "/".join(segs[:depth])), {}).setdefault(segs[depth], [0, 0, 0])
                for i in range(3):
                    c[i] += stats[k][i]
        names = {}
        for p, children in parents.items():
            total = sum(c[0] for c in children.values())
            rare = {c for c, v in children.items() if len(children) > U.MAX_CHILDREN and v[0] < U.RARE_CHILD * total
                    and v[2] < U.MIN_LABELS}
            names.update({(p, c): "*" for c in rare})
            order = sorted((v[1] / v[2], c, v) for c, v in children.items() if c not in rare and v[2] >= U.MIN_LABELS)
            branches, last = [], None
            for share, c, v in order:
                if last:
                    pooled = (v[1] + last[1]) / (v[2] + last[2])
                    z2 = U.SIMILAR_Z**2 * pooled * (1 - pooled) * (1 / v[2] + 1 / last[2])
                if last is None or (share - last[1] / last[2])**2 > z2:
                    branches.append([])
                branches[-1].append(c)
                last = v
            for b in branches:
                name = "|".join(sorted(b)) if len(b) <= U.MAX_CHILDREN else f"{min(b)}|+{len(b) - 1}"
                names.update({(p, c): name for c in b})
        for k, segs in now.items():
            if len(segs) > depth:
                name = names.get(((k[0], "/".join(segs[:depth])), segs[depth]), segs[depth])
                now[k] = (*segs[:depth], name, *segs[depth + 1:])
    sums = {}
    for k, segs in now.items():
        t = sums.setdefault((k[0], segs), [0, 0])
        t[0] += stats[k][1]
        t[1] += stats[k][2]
    key = lambda host, segs: "/".join((host, "/".join(segs)))
    out = {}
    for k, segs in now.items():
        bad, n = sums[k[0], segs]
        purity = (bad + 1) / (n + 2)
        out[key(*k)] = (key(k[0], segs), purity, "block" if purity >= reject else "allow")
    return out


def test_templates_equal_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(3000):
        host = rng.choice(["a", "b", "c"])
        first = rng.choice(["en", "de", "spam", "win", "tag", "user"])
        second = f"{rng.randrange(50)}" if first != "user" else f"u{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}"
        bad = {"spam": 0.95, "win": 0.97, "tag": 0.5, "de": 0.1, "en": 0.05, "user": 0.9}[first]
        label = None if rng.random() < 0.3 or (first == "en" and host == "c") else "block" if rng.random() < bad else "allow"
        if rng.random() < 0.2:                    # many sections, most of them rare, some of these labelled often
            k = rng.choice([rng.randrange(60), 7, 8, 9])
            first, second = f"s{chr(97 + k % 26)}{chr(97 + k // 26)}", f"{rng.randrange(9)}|*"
            label = ("block" if k == 7 else "allow") if k in (7, 8, 9) else None
        rows.append((host, f"/{first}/{second}" + rng.choice(["", "/x", ".html"]), label))
    df = spark.createDataFrame(rows, "host string, path string, label string").repartition(5)
    got = {r["shape"]: (r.template, r.purity, r.method) for r in U.template_verdicts(df).collect()}
    want = brute_templates(rows)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - v[1]) < 1e-12 and got[k][2] == v[2] for k, v in want.items())
    assert {"block", "allow"} == {v[2] for v in want.values()}


def test_pages_equal_brute_force(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    rows = [(r.page_id, *plain(r.url)) for r in pages.collect()]
    want = brute_templates([(h, p, v) for _, h, p, _, v in rows])
    out = {r.page_id: r for r in U.judge_urls(pages).collect()}
    for i, host, path, rule, verdict in rows:
        assert (out[i].host, out[i].path, out[i].rule) == (host, path, rule)
        assert out[i].verdict == (verdict or next(v for t, _, v in want.values() if t == out[i].template))


def test_a_blocked_section_among_many_stays_alone(spark):
    sections = ["de"] + [f"s{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(39)]
    out = U.judge_urls(pages(spark, [f"http://big.example.com/{s}/{i}" for s in sections for i in range(12)])).collect()
    assert {r.path.split("/")[1] for r in out if r.verdict == "block"} == {"de"}
    assert {r.template for r in out} == {"big.example.com/de/{n}", "big.example.com/*/{n}"}


def test_allowed_labels_do_not_hide_a_rare_bad_section(spark):
    rows = [("h", f"/{chr(97 + i % 26)}{chr(97 + i // 26)}/{j}", "block" if i == 7 else "allow") for i in range(60) for j in range(10)]
    rows += [("h", f"/x{chr(97 + i)}y/{j}", None) for i in range(20) for j in range(10)]
    out = {r["shape"]: r for r in U.template_verdicts(spark.createDataFrame(rows, "host string, path string, label string")).collect()}
    assert [s for s, r in out.items() if r.method == "block"] == ["h/ha/{n}"]
    assert {r.template for r in out.values()} == {"h/ha/{n}", "h/aa|+58/{n}", "h/*/{n}"}       # long names are cut short
    assert sum(r.n for r in out.values()) == len(rows)


def test_one_long_url_among_many(spark):
    """2,000 segments of one url are no work: only levels at which a host branches are walked."""
    urls = [f"http://h/{'ab'[i % 2]}/{i}" for i in range(1000)] + ["http://h/" + "seg/" * 2000, "http://net/" + "x/" * 500]
    began = time.monotonic()
    out = {r.page_id: r for r in U.judge_urls(pages(spark, urls)).collect()}
    assert time.monotonic() - began < 60 and len(out) == 1002
    want = brute_templates([(*plain(u)[:2], plain(u)[3]) for u in urls[:1000]])
    assert {r.template for i, r in out.items() if i < 1000} == {v[0] for v in want.values()}
    assert out[1000].template == "h/" + "/".join(["seg"] * 2000) and out[1001].verdict == "block"


def test_levels_that_branch(spark):
    rows = [("h", "/" + "/".join(["a"] * 5 + [f"c{chr(97 + i)}", "z"]), "allow" if i else "block") for i in range(2) for _ in range(9)]
    rows += [("g", f"/{chr(97 + i % 26)}{chr(97 + i // 26)}/deep/er", None) for i in range(31)] + [("k", "/x/y", None), ("k", "/z/y", None)]
    df = spark.createDataFrame(rows, "host string, path string, label string")
    shapes = df.select("host", U.path_shape(F.col("path")).alias("segs"), F.when(F.col("label").isNotNull(), 1).otherwise(0).alias("labelled"))
    assert U.branching_levels(shapes) == [0, 5]
