import math
from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

from inkveil.llm.url_filter import RULES, filter_urls, host_of, mine, path_of, tokens_of


def by_hand(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url[url.index("://") + 3 :]
    end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = rest[:end].translate({c: c + 32 for c in range(65, 91)})
    path = rest[end:]
    path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    best = None
    for rule, verdict in RULES:
        name, _, prefix = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + prefix):
            if best is None or len(rule) > len(best[0]):
                best = rule, verdict
    return host, path, *(best or (None, None))


def test_listed_rules(spark):
    urls = [
        "http://a.com/x", "http://COM/", "http://a.com", "http://example.com/en/1", "https://WWW.Example.com/en/", "http://m.example.com/en",
        "http://notexample.com/en/", "http://x.net/es/1?q=http://y.com/", "http://x.net/fr/#a", "http://x.net/de/", "no scheme.com/", "",
        None, "http://", "http:///en/", "http://a.com:80/x", "http://u@a.com/en/", "x://y://z.com/", "http://é.com/\n/x", "http://a.com?x=/en/",
        "http://example.com/EN/", "HTTP://sub.www.example.com/en/x",
    ]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in filter_urls(df).collect()}
    for k, url in enumerate(urls):
        host, path, rule, verdict = by_hand(url)
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule), url
        if verdict:
            assert got[k].verdict == verdict
        assert got[k].verdict in ("allow", "block")


def test_mined_rules_by_brute_force(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    url, host, path = F.col("url"), host_of(F.col("url")), path_of(F.col("url"))
    rows = [(tuple(r.t), by_hand(r.url)[3]) for r in pages.select(tokens_of(url, host, path).alias("t"), "url").collect()]
    known = [r for r in rows if r[1]]
    everything, with_label = Counter(), Counter()
    for tokens, verdict in known:
        for n in (1, 2, 3):
            for some in combinations(sorted(tokens), n):
                everything[some] += 1
                with_label[some, verdict] += 1
    least = math.ceil(0.01 * len(known))
    strong = {k: (c / everything[k[0]], c) for k, c in with_label.items() if c >= least and c / everything[k[0]] >= 0.8}
    kept = {
        k: v
        for k, v in strong.items()
        if not any(s[1] == k[1] and set(s[0]) < set(k[0]) and w[0] >= v[0] for s, w in strong.items())
    }
    df = spark.createDataFrame([(list(t), v) for t, v in known], "tokens array<string>, verdict string")
    got = {(tuple(r.tokens), r.verdict): (r.confidence, r.n) for r in mine(df).collect()}
    assert got == kept


def test_given_labels_decide(spark):
    pages = spark.createDataFrame([(1, "http://bad.org/x/1"), (2, "http://good.org/x/2"), (3, "http://other.org/")], "page_id long, url string")
    labels = spark.createDataFrame(
        [(f"http://bad.org/y/{k}", "block") for k in range(5)] + [(f"http://good.org/y/{k}", "allow") for k in range(5)] + [(None, "block")],
        "url string, verdict string",
    )
    got = {r.page_id: (r.verdict, r.mined_rule) for r in filter_urls(pages, labels=labels).collect()}
    assert got == {1: ("block", "host:bad"), 2: ("allow", "host:good"), 3: ("allow", None)}


def test_no_labels_no_rules(spark):
    pages = spark.createDataFrame([(1, "http://x.org/")], "page_id long, url string")
    assert filter_urls(pages).first().verdict == "allow"


def test_rules_of_any_size_by_brute_force(spark):
    """Only all four tokens together say block: each set of three is as often allowed."""
    four = ("a", "b", "c", "d")
    known = [(four, "block")] * 8 + [(some, "allow") for some in combinations(four, 3)] * 8
    known += [(("e", "f", "g", "h", "i"), "block")] * 8 + [(some, "allow") for some in combinations("efghi", 4)] * 8
    everything, with_label = Counter(), Counter()
    for tokens, verdict in known:
        for n in range(1, len(tokens) + 1):
            for some in combinations(tokens, n):
                everything[some] += 1
                with_label[some, verdict] += 1
    strong = {k: (c / everything[k[0]], c) for k, c in with_label.items() if c >= 0.01 * len(known) and c / everything[k[0]] >= 0.8}
    kept = {
        k: v
        for k, v in strong.items()
        if not any(s[1] == k[1] and set(s[0]) < set(k[0]) and w[0] >= v[0] for s, w in strong.items())
    }
    assert kept[four, "block"] == (1, 8) and kept[tuple("efghi"), "block"] == (1, 8)
    df = spark.createDataFrame([(list(t), v) for t, v in known], "tokens array<string>, verdict string")
    got = {(tuple(r.tokens), r.verdict): (r.confidence, r.n) for r in mine(df).collect()}
    assert got == kept


def test_rule_of_four_tokens_decides(spark):
    def url(sub, host, path, name):
        return f"http://{sub}.{host}.org/{path}?{name}=1"

    block = ("www", "bad", "x", "q")
    allow = [block[:k] + ("other",) + block[k + 1 :] for k in range(4)]
    labels = [(url(*block), "block")] * 4 + [(url(*s), "allow") for s in allow] * 4
    pages = spark.createDataFrame([(1, url(*block)), (2, url(*allow[0]))], "page_id long, url string")
    got = {r.page_id: r.verdict for r in filter_urls(pages, labels=spark.createDataFrame(labels, "url string, verdict string")).collect()}
    assert got == {1: "block", 2: "allow"}
