import math
import random
from collections import Counter

from loanmart.llm import url_filter
from loanmart.llm.catalog import URL_RULES


def plain(url):
    rest = url.partition("://")[2] if url and "://" in url else ""
    cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    path = rest[cut:]
    end = min([i for i in (path.find(c) for c in "?#") if i >= 0], default=len(path))
    return host, path[:end], host + rest[cut:] if "://" in (url or "") else (url or "")


def judged(host, path):
    best = None
    for verdict, rule in URL_RULES:
        of, _, prefix = rule.partition("/")
        if (host == of or host.endswith("." + of)) and path.startswith("/" + prefix) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return best


def urls():
    rng = random.Random(1)
    out = []
    for i in range(300):
        lang = rng.choice(["en", "es", "fr", "de"])
        host = rng.choice(["ab.example.com", "www.example.com", "x.example.net", "y.example.org", "Example.COM", "com", "net"])
        out.append(f"https://{host}/{lang}/{'w' * rng.randint(0, 3) if lang in ('es', 'fr') else 'q'}{i}{rng.choice(['', '?a=/b', '#t'])}")
    out += [None, "", "no scheme", "http://", "http://com", "http://com/", "http://net?x", "HTTP://A.B.Com/é?://", "ftp://x.net/fr/\n"]
    return out + ["https://hot.example.net/de/1"] * 40


def frame(spark, found):
    rows = [(i, u, "x", None) for i, u in enumerate(found)] + [(None, found[0], "x", None)] if found else []
    return spark.createDataFrame(rows, "page_id long, url string, html string, rule string")


def test_hosts_paths_and_rules(spark):
    found = urls()
    got = url_filter.judge_urls(frame(spark, found), URL_RULES)
    assert got.columns == ["page_id", "url", "html", "host", "path", "rule", "verdict", "score"]
    rows = got.collect()
    assert len(rows) == len(found) + 1
    for r in rows:
        host, path, _ = plain(r["url"])
        rule = judged(host, path)
        assert (r["host"], r["path"]) == (host, path)
        assert r["rule"] == (rule and rule[1]) and r["verdict"] in ("allow", "block")
        assert rule is None or r["verdict"] == rule[0]


def test_scores_match_plain_models(spark):
    found = urls()
    rows = url_filter.judge_urls(frame(spark, found), URL_RULES).collect()
    held = {r["url"]: r["h"] for r in frame(spark, found).selectExpr("url", "pmod(xxhash64(url), 5) = 0 as h").collect()}
    models = {}
    for side in ("allow", "block"):
        counts, after = Counter(), {}
        for u in [*found, found[0]]:
            host, path, said = plain(u)
            rule = judged(host, path)
            if rule is None or rule[0] != side or held[u]:
                continue
            text = "\x02" * 5 + said + "\x03"
            for i in range(5, len(text)):
                for k in range(6):
                    counts[text[i - k : i + 1]] += 1
                    after.setdefault(text[i - k : i], set()).add(text[i])
        totals = Counter()
        for g, n in counts.items():
            totals[g[:-1]] += n
        models[side] = (counts, totals, after)

    def logp(side, gram):
        counts, totals, after = models[side]
        p = 1 / 256
        for k in range(6):
            g = gram[5 - k :]
            n, kinds = totals[g[:-1]], len(after.get(g[:-1], ()))
            if n:
                p = (counts[g] + kinds * p) / (n + kinds)
        return math.log(p)

    for r in rows[::17]:
        text = "\x02" * 5 + plain(r["url"])[2] + "\x03"
        grams = [text[i - 5 : i + 1] for i in range(5, len(text))]
        want = sum(logp("allow", g) - logp("block", g) for g in grams) / len(grams)
        assert abs(want - r["score"]) < 1e-9


def test_model_parts_what_rules_would(spark):
    """Urls that look like judged ones, on hosts no rule fits."""
    look = [(f"https://x.example.net/fr/zz{i}" if i % 2 else f"https://good.com/en/aa{i}") for i in range(200)]
    unseen = ["https://x.example.org/fr/zz9999", "https://good.org/en/aa9999"]
    got = {r["url"]: r["verdict"] for r in url_filter.judge_urls(frame(spark, look + unseen), URL_RULES).collect()}
    assert [got[u] for u in unseen] == ["block", "allow"]


def test_empty_and_without_rules(spark):
    assert url_filter.judge_urls(frame(spark, []), URL_RULES).count() == 0
    rows = url_filter.judge_urls(frame(spark, ["http://a/b", None]), []).collect()
    assert {r["verdict"] for r in rows} == {"allow"} and {r["rule"] for r in rows} == {None}
