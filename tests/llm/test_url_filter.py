import math
import re
from collections import Counter

import pytest

from levyscape.llm import url_filter

from .helpers import rows

SF = "/root/testdata/sf0.001"


def plain(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


URLS = [
    "http://example.org/es/1", "https://A.Example.ORG/en/12?x#y", "http://example.org/en/2", "http://x.org", "http://x.org?a=/", "http://notexample.org/es/",
    "http://example.com/fr/1", "http://sub.example.com/de/", "com://com/fr/", "http://com/de/x", "http://x.net/fr/", "no scheme", "", None, "http://", "a://b://org/",
    "http://É.org/ü", "http://x.org:80/", "http://x.org/" + "a" * 3000,
]


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "x", "y", "z") for i, u in enumerate(urls)], "page_id long, url string, html string, score string, ruled string")


def test_hosts_paths_and_rules(spark):
    out = url_filter.judge(pages(spark, URLS + URLS)).collect()
    assert len(out) == 2 * len(URLS)
    verdicts = {}
    for r in out:
        host, path, rule, verdict = plain((URLS + URLS)[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule), r
        assert r.verdict in ("allow", "block") and (verdict is None or r.verdict == verdict)
        verdicts.setdefault((URLS + URLS)[r.page_id], set()).add(r.verdict)
    assert all(len(v) == 1 for v in verdicts.values())


def test_query_on_the_test_table_and_empty_table(spark):
    table = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    out = url_filter.query(spark, SF).collect()
    assert {r.page_id: (r.host, r.path, r.rule) for r in out} == {i: plain(u)[:3] for i, u in table.items()}
    assert url_filter.judge(pages(spark, [])).collect() == []
    alone = url_filter.judge(pages(spark, ["http://a.net/x"])).collect()
    assert [r.verdict for r in alone] == ["allow"]


def test_models_tell_held_out_urls_apart(spark):
    good = [f"http://good{i % 40}.net/articles/{i}" for i in range(400)]
    bad = [f"http://spam{i % 40}.net/casino/{i}" for i in range(400)]
    taught = spark.createDataFrame([(u, u in set(good)) for u in good[:300] + bad[:300]], "url string, accepted boolean")
    model = url_filter.train(taught)
    held = spark.createDataFrame([(u, u in set(good)) for u in good[300:] + bad[300:]], "url string, accepted boolean")
    out = url_filter.scored(held, model)
    least = url_filter.threshold(out)
    right = sum((r.score >= least) == r.row.accepted for r in out.collect())
    assert right / 200 >= 0.97
    again = url_filter.train(taught.repartition(5))
    assert rows(again) == rows(model)


def plain_scores(taught, urls):
    """Log-likelihood difference by byte, from counts in dictionaries."""
    order, strength = url_filter.ORDER, url_filter.STRENGTH
    counts = {True: Counter(), False: Counter()}

    def padded(url):
        return bytes([url_filter.START]) * order + (url or "").encode() + bytes([url_filter.STOP])

    for url, accepted in taught:
        p = padded(url)
        for i in range(order, len(p)):
            for k in range(order + 1):
                counts[accepted][p[i - k : i + 1]] += 1
                counts[accepted]["before", p[i - k : i]] += 1

    def chance(cls, p, i):
        x = 1 / 256
        for k in range(order + 1):
            x = (counts[cls][p[i - k : i + 1]] + strength * x) / (counts[cls]["before", p[i - k : i]] + strength)
        return x

    out = []
    for url in urls:
        p = padded(url)
        logs = [math.log(chance(True, p, i)) - math.log(chance(False, p, i)) for i in range(order, len(p))]
        out.append(sum(logs) / len(logs))
    return out


def test_scores_are_those_of_plain_counts(spark):
    table = [r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    taught = [(u, i % 3 == 0) for i, u in enumerate(table + URLS)]
    urls = URLS + table[:60] + table[:5]
    model = url_filter.train(spark.createDataFrame(taught, "url string, accepted boolean"))
    df = spark.createDataFrame(list(enumerate(urls)), "n long, url string").repartition(3)
    got = {r.row.n: r.score for r in url_filter.scored(df, model).collect()}
    assert len(got) == len(urls)
    for n, x in enumerate(plain_scores(taught, urls)):
        assert got[n] == pytest.approx(x, rel=1e-9, abs=1e-12)
