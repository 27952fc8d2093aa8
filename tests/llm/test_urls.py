"""URL verdicts: rules against plain Python, features against plain Python, trees on URLs they have not seen."""

import collections
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from hourgrid.llm import urls

FIELDS = "page_id bigint, url string, host string, depth int, _label string, score string"
ODD = [None, "", "no scheme", "://", "http://", "HTTP://WWW.Example.ORG/es/1", "http://example.org", "http://example.org/es", "http://example.org/es/", "http://example.org?x=/es/", "http://a.b.example.org/en/12#/es/",
       "http://badexample.org/es/1", "http://Org/", "http://com/de/x", "http://shop.com/de/x://y.org/", "http://shop.com/fr/?a=1&b=2#c", "x://ÀB.com/de/é", "http://" + "a." * 3000 + "com/de/" + "z" * 50_000, "http://org.net/", "a\nb://c.org/\nd", "http://u@x.org:80/"]


def split_plain(url):
    _, found, rest = (url or "").partition("://")
    rest = rest if found else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if c.isascii() else c for c in host), path


def rule_plain(host, path, rules):
    fits = [(len(h + p), len(h), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else (None, None)


def entropy_plain(text):
    counts = collections.Counter(c if c in urls.ALPHABET else "" for c in text)
    return -sum(n / len(text) * math.log2(n / len(text)) for n in counts.values()) if text else 0.0


def pages(spark, texts):
    return spark.createDataFrame([(i, t, "h", 7, "l", "s") for i, t in enumerate(texts)], FIELDS)


RULES = (*urls.RULES, ("allow", "example.org", "/en/1"), ("allow", "b.example.org", "/"), ("block", "org", "/b.example"))


@pytest.mark.parametrize("rules", [urls.RULES, RULES, ()])
def test_rules(spark, rules):
    r = random.Random(1)
    hosts, paths = ["org", "example.org", "b.example.org", "a.b.example.org", "shop.com", "com", "m.net", ""], ["", "/", "/es/", "/es/1", "/en/1", "/en/2", "/fr/", "/de/9", "/b.example.org"]
    texts = [*ODD, *(r.choice(["http://", "https://", "//"]) + r.choice(hosts) + r.choice(paths) + r.choice(["", "?q=1", "#x"]) for _ in range(400))]
    got = urls.judge(pages(spark, texts), urls.Filter({}, 0.0, None, "allow"), rules).orderBy("page_id").collect()
    assert len(got) == len(texts)
    for row, text in zip(got, texts):
        host, path = split_plain(text)
        verdict, rule = rule_plain(host, path, rules)
        assert (row.url, row.host, row.path, row.rule, row.verdict, row.depth, row._label) == (text, host, path, rule, verdict or "allow", 7, "l")


def test_lexical_features(spark):
    host, path = urls.host_and_path(F.col("url"))
    rows = urls.lexical(pages(spark, ODD).select("page_id", "url", host.alias("h"), path.alias("p")), "url", "h", "p").orderBy("page_id").collect()
    for row, text in zip(rows, ODD):
        host, path = split_plain(text)
        text = text or ""
        query = text.split("#")[0].partition("?")[2] if "#" not in text.partition("?")[0] else text.partition("?")[2].split("#")[0]
        segments = [s for s in path.split("/") if s]
        assert (row.url_length, row.host_length, row.path_length, row.depth) == (len(text), len(host), len(path), len(segments))
        assert row.parameters == (query.count("&") + 1 if query else 0) and row.longest_segment == max(map(len, segments), default=0)
        assert row.digit_ratio == pytest.approx(sum(c in "0123456789" for c in text) / max(1, len(text)))
        assert row.entropy == pytest.approx(entropy_plain("".join(c.lower() if c.isascii() else c for c in text)), abs=1e-9)
        assert (row._suffix, row._domain) == (host.split(".")[-1], ".".join(host.split(".")[-2:]))


def made(n, seed):
    """URLs of spam, with digits and parameters, and of articles; labelled hosts and others alike."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        spam = r.random() < 0.5
        word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(4, 9)))
        path = f"/{r.randint(10**6, 10**9)}?id={r.randint(1, 10**6)}&ref={r.randint(1, 99)}&x=1" if spam else f"/{word()}/{word()}-{word()}"
        out.append((spam, f"http://{word()}.{'spam' if spam else 'good'}.{r.choice(['com', 'net'])}{path}", f"http://{word()}.io{path}"))
    return out


LABELS = tuple((v, f"{h}.{t}", "/") for v, h in (("block", "spam"), ("allow", "good")) for t in ("com", "net"))


def test_trees_on_unseen_hosts(spark):
    docs = pages(spark, [u for _, u, _ in made(600, 2)])
    found = urls.fit(docs, LABELS)
    unseen = made(300, 3)
    got = [r.verdict for r in urls.judge(pages(spark, [u for *_, u in unseen]), found, LABELS).orderBy("page_id").collect()]
    assert sum((v == "block") == spam for v, (spam, *_) in zip(got, unseen)) >= 270


def test_labels_of_one_kind_and_none(spark):
    texts = ["http://a.spam.com/1", None, "http://b.io/"]
    verdicts = lambda rules: [r.verdict for r in urls.judge(pages(spark, texts), urls.fit(pages(spark, texts), rules), rules).orderBy("page_id").collect()]
    assert verdicts(LABELS) == ["block"] * 3
    assert verdicts(()) == ["allow"] * 3
    empty = pages(spark, texts).limit(0)
    assert urls.judge(empty, urls.fit(empty)).count() == 0


def test_the_sample_is_bounded(spark, monkeypatch):
    """A URL on a third of all rows counts once, and the sample follows its parameter."""
    monkeypatch.setattr(urls, "SAMPLE", 60)
    docs = pages(spark, [u for _, u, _ in made(400, 4)] + ["http://a.spam.com/1"] * 200)
    seen = []
    monkeypatch.setattr(urls, "staged", lambda df: seen.append(df.count()) or df)
    urls.fit(docs, LABELS)
    assert 20 < seen[0] < 120


def test_all_labelled_urls_are_learned_from(spark, monkeypatch):
    class Seen(Exception):
        pass

    def stop(df):
        raise Seen(df.count())

    monkeypatch.setattr(urls, "staged", stop)
    docs = spark.range(30_000).select(F.concat(F.lit("http://a"), "id", F.lit(".spam.com/")).alias("url"))
    with pytest.raises(Seen) as seen:
        urls.fit(docs.union(docs), LABELS)
    assert seen.value.args == (30_000,)
