"""URL verdicts against a plain reading of the rules and of the models."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

from raretide.llm.url_filter import ORDER, RULES, judge_urls

SCHEMA = "page_id long, url string, html string, host string, text string, gram string, id long, given string"


def _table(spark, urls):
    return spark.createDataFrame([(i, u, "<p>", "h", "t", "g", 1, "allow") for i, u in urls], SCHEMA)


def _lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def _parts(url):
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = re.search(r"[/?#]|\Z", rest).start()
    return _lower(rest[:end]), re.split("[?#]", rest[end:])[0]


def _rule(host, path, rules):
    fits = [(h + p, v, h) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return min(fits, key=lambda r: (-len(r[0]), -len(r[2])), default=(None, None))[:2]


def _judge(urls, rules=RULES):
    """Per row: host, path, rule, verdict, score, by dictionaries of counts."""
    rows, texts = [], {}
    for _, url in urls:
        host, path = _parts(url)
        rule, verdict = _rule(host, path, rules)
        text = host + path if "://" in (url or "") else _lower(url or "")
        rows.append((host, path, rule, verdict, text))
        texts[text] = max(filter(None, (verdict, texts.get(text))), default=None)
    held = {t for t, v in texts.items() if v and hashlib.md5(t.encode()).hexdigest()[0] in "0123"}
    padded = {t: "\x02" * ORDER + t + "\x03" for t in texts}
    counts = {v: Counter() for v in ("allow", "block")}
    for t, v in texts.items():
        if v and t not in held:
            for i in range(ORDER, len(padded[t])):
                counts[v].update((k, padded[t][i - k : i + 1]) for k in range(ORDER + 1))
    totals = {v: Counter() for v in counts}
    kinds = {v: Counter() for v in counts}
    for v, c in counts.items():
        for (k, g), n in c.items():
            totals[v][k, g[:-1]] += n
            kinds[v][k, g[:-1]] += 1
    letters = len({c for t in padded.values() for c in t[ORDER:]}) + 1

    def p(v, t, i):
        out = 1 / letters
        for k in range(ORDER + 1):
            g = t[i - k : i + 1]
            if n := totals[v][k, g[:-1]]:
                out = (counts[v][k, g] + kinds[v][k, g[:-1]] * out) / (n + kinds[v][k, g[:-1]])
        return out

    score = {}
    for t, s in padded.items():
        each = [math.log(p("allow", s, i)) - math.log(p("block", s, i)) for i in range(ORDER, len(s))]
        score[t] = sum(each) / len(each)
    a, b = ([score[t] for t in held if texts[t] == v] for v in ("allow", "block"))
    cuts = sorted({math.floor(x * 100) / 100 for x in score.values()}, key=lambda c: (sum(x < c for x in a) * len(b) + sum(x >= c for x in b) * len(a), abs(c), c))
    least = cuts[0] if a and b else 0
    return [(h, p_, r, v or ("allow" if score[t] >= least else "block"), round(score[t], 3)) for h, p_, r, v, t in rows]


def _odd():
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(4))
    out = []
    for i in range(300):
        host = r.choice(["a.org", "example.org", "m.example.org", "x.com", "example.net", "Y.COM", "net"])
        out.append((i, f"http://{host}/{r.choice(['en', 'es', 'fr', 'de'])}/{word()}{r.choice(['', '?q=1', '#top', '/'])}"))
    odd = [None, "", "no scheme", "a.org/x", "http://", "://", "HTTP://User@Example.ORG:80/es/", "http://example.org", "http://example.org?x/es/", "http://org/", "http://notorg/", "x://y://org/", "http://a.org/\nline", "http://ünï.org/漢字𝔘/", "http://example.org/es", "http://c.com/fr/" + "long" * 5000]
    out += [(1000 + i, u) for i, u in enumerate(odd)] + [(7, out[7][1])] * 3 + [(None, "http://example.org/en/12")] * 2
    return out


def test_verdicts_equal_a_plain_reading(spark):
    urls = _odd()
    out = judge_urls(_table(spark, urls)).collect()
    got = sorted((str(x.page_id), x.host, x.path, str(x.rule), x.verdict, round(x.score, 3)) for x in out)
    expected = sorted((str(i), h, p, str(r), v, s) for (i, _), (h, p, r, v, s) in zip(urls, _judge(urls), strict=True))
    assert [x[:5] for x in got] == [x[:5] for x in expected]
    assert all(abs(a[5] - b[5]) <= 0.002 for a, b in zip(got, expected, strict=True))


def test_models_carry_rules_over_to_other_hosts(spark):
    r = random.Random(9)
    good, bad = ["garden", "museum", "library", "recipe"], ["casino", "jackpot", "viagra", "xxxcam"]
    urls = [(i, f"http://h{r.randrange(40)}.{'ok' if i % 2 else 'no'}/{r.choice(good if i % 2 else bad)}-{r.choice(good if i % 2 else bad)}/{r.randrange(99)}") for i in range(800)]
    asked = [(1000 + i, f"http://s{i}.zz/{r.choice(good if i % 2 else bad)}/{i}") for i in range(200)]
    out = judge_urls(_table(spark, urls + asked), rules=(("allow", "ok", "/"), ("block", "no", "/"))).filter("page_id >= 1000").collect()
    assert sum((x.verdict == "allow") == bool(x.page_id % 2) for x in out) >= 190 and all(x.rule is None for x in out)


def test_no_rows_and_no_rules(spark):
    assert judge_urls(_table(spark, [])).count() == 0
    out = judge_urls(_table(spark, _odd()), rules=()).collect()
    assert {(x.rule, x.verdict, x.score) for x in out} == {(None, "allow", 0.0)}
    ties = (("block", "b.org", "/x"), ("allow", "org", "/x/y"), ("allow", "b.org", "/x"))
    assert [x.verdict for x in judge_urls(_table(spark, [(1, "http://b.org/x/y")]), rules=ties).collect()] == ["allow"]
