"""Download source rules and address models against a plain statement."""

import hashlib
import math
import random
from collections import Counter

from chromaframe.llm.sources_filter import judge_sources

RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def parts(url):
    if not url or "://" not in url:
        return "", "", url or ""
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    end = min([path.index(c) for c in "?#" if c in path], default=len(path))
    return host, path[:end], host + rest[cut:]


def ruled(host, path):
    fit = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


def judged(urls, order=5, strength=2.0):
    rows = [(u, *parts(u)) for u in urls]
    labelled = [(t, ruled(h, p)[1]) for _, h, p, t in rows]
    fits = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % 5 != 0
    grams = {v: Counter() for v in ("allow", "block")}
    contexts = {v: Counter() for v in ("allow", "block")}
    window = lambda t: [("\x02" * (order - 1) + t + "\x03")[i:i + order] for i in range(len(t) + 1)]
    for t, v in labelled:
        if v and fits(t):
            for w in window(t):
                for k in range(1, order + 1):
                    grams[v][w[-k:]] += 1
                    contexts[v][(k, w[order - k:order - 1])] += 1
    known = bool(grams["allow"]) and bool(grams["block"])

    def score(t):
        total = 0
        for w in window(t):
            p = {v: 1 / 256 for v in grams}
            for k in range(1, order + 1):
                for v in p:
                    p[v] = (grams[v][w[-k:]] + strength * p[v]) / (contexts[v][(k, w[order - k:order - 1])] + strength)
            d = (math.log(p["allow"]) - math.log(p["block"])) * 1e6
            total += math.floor(abs(d) + 0.5) * (1 if d >= 0 else -1)
        return total // (len(t) + 1)
    bins = {}
    for t, v in labelled:
        if v and not fits(t):
            b = max(-30000, min(30000, score(t) // 1000))
            bins.setdefault(b, Counter())[v] += 1
    a, r = (sum(c[v] for c in bins.values()) for v in ("allow", "block"))
    least = 0
    if a and r:
        up, best = Counter(), None
        for b in sorted(bins, reverse=True):
            up += bins[b]
            now = (up["allow"] / a - up["block"] / r, -abs(b), -b)
            best, least = (now, b) if best is None or now > best else (best, least)
        below = [b for b in bins if b < least]
        least = (least + max(below) + 1) // 2 if below else least
    out = []
    for u, h, p, t in rows:
        rule, verdict = ruled(h, p)
        if verdict:
            out.append((u, h, p, rule, verdict, None))
        else:
            s = score(t)
            out.append((u, h, p, None, "allow" if not known or s // 1000 >= least else "block", s))
    return out


def test_rules_and_models_equal_the_plain_rule(spark):
    rnd = random.Random(2)
    hosts = ["www.Example.org", "art.org", "casino-win.example.com", "example.com", "pics.net", "free-bets.net", "org", "myorg", "example.org.net"]
    urls = []
    for _ in range(400):
        path = rnd.choice(["/", "", "/es/", "/en/1", "/en/", "/fr/", "/de/", "/DE/"]) + rnd.choice(["", str(rnd.randrange(10 ** 6)), "best-odds-win", "käse/日本"])
        urls.append(rnd.choice(["http", "https", "ftp"]) + "://" + rnd.choice(hosts) + path + rnd.choice(["", "?a=1", "#top", "?u=http://x.org/"]))
    urls += [None, "", "no scheme", "http://", "a://b://c/d", "http://art.org/\nline", "http://pics.net/" + "ab" * 5000] + urls[:30] * 3
    df = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls)], "weights_id int, source_url string, verdict string").repartition(5)
    got = judge_sources(df, RULES)
    assert got.columns == ["weights_id", "source_url", "host", "path", "rule", "verdict", "score"]
    rows = sorted(map(tuple, got.collect()))
    assert [r[1:] for r in rows] == judged(urls)


def test_models_tell_kinds_of_addresses_apart(spark):
    rnd = random.Random(6)
    name = lambda words: "-".join(rnd.choice(words) for _ in range(2)) + f"{rnd.randrange(999)}.net"
    good, bad = ["atelier", "palette", "lineart", "gallery"], ["casino", "jackpot", "bets", "pills"]
    rows = [(f"https://{rnd.choice(good)}-{i}.org/fr/", None) for i in range(120)] + [(f"https://{rnd.choice(bad)}-{i}.com/de/", None) for i in range(120)]
    rows += [(f"https://{name(good)}/x", "allow") for _ in range(60)] + [(f"https://{name(bad)}/x", "block") for _ in range(60)]
    got = judge_sources(spark.createDataFrame(rows, "source_url string, want string"), RULES).where("want IS NOT NULL").collect()
    assert sum(r.want == r.verdict for r in got) >= 108


def test_without_examples_the_default_holds(spark):
    df = spark.createDataFrame([("http://pics.net/a",), ("http://pics.net/b",)], "source_url string")
    assert {r.verdict for r in judge_sources(df, RULES, default="block").collect()} == {"block"}
    assert {r.verdict for r in judge_sources(df, ()).collect()} == {"allow"}
    assert judge_sources(df.limit(0), RULES).count() == 0
    # Examples of one kind only, some of them kept for the threshold.
    one = spark.createDataFrame([(f"http://art.org/{i}",) for i in range(40)] + [("http://pics.net/b",)], "source_url string")
    assert {r.verdict for r in judge_sources(one, RULES).collect()} == {"allow"}
