import random
import re

from pyspark.sql import functions as F

from tests.llm.conftest import same
from virocohort.llm.url_filter import LOWER, UPPER, url_filter


def brute(rows, rules, default="allow"):
    out = []
    for i, url in rows:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host):])[0]
        host = host.translate(str.maketrans(UPPER, LOWER))
        fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if h is not None and p is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        out.append((i, host, path, best and best[3], best[4] if best else default))
    return out


def test_equals_brute_force(spark):
    r = random.Random(2)
    hosts = ["com", "a.com", "b.a.com", "c.b.a.com", "ba.com", "x.org", "org"]
    paths = ["", "/", "/e", "/en", "/en/", "/en/a", "/en/a/b", "/é", "/é/"]
    rules = list({(r.choice(hosts), r.choice(paths[1:])): r.choice(("allow", "block")) for _ in range(30)}.items())
    rules = [(h, p, v) for (h, p), v in rules] + [(None, "/", "block"), ("com", None, "block")]
    rows = [(i, f"http://{r.choice(('', 'W.', 'w.w.'))}{r.choice(hosts).upper() if r.random() < .3 else r.choice(hosts)}{r.choice(paths)}{r.choice(('', '?q=/en', '#x', 'zz'))}") for i in range(400)]
    rows += [(900, None), (901, ""), (902, "no scheme/en/"), (903, "://"), (904, "http://a.com"), (905, "http://a.com?x://y/en/"), (906, "http://" + "a." * 3000 + "com/en/" + "p" * 20000), (None, "http://a.com/en/"), (3, rows[3][1]), (3, rows[3][1])]
    rows += [(1000 + i, "http://a.com/en/a") for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit(0) for c in ("host", "path", "site", "rule", "key", "id", "given", "block")})
    got = url_filter(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), block_rows=40)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    same(got.collect(), brute(rows, rules))


def test_no_python_in_the_plan(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    plan = url_filter(pages, spark.createDataFrame([("com", "/", "block")], "host string, path string, verdict string"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|CartesianProduct|BroadcastNestedLoop", plan)


def test_without_pages_or_rules(spark):
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert [tuple(r) for r in url_filter(pages, rules, default="block").collect()] == [(1, "a.com", "/", None, "block")]
    assert url_filter(pages.where("false"), rules).collect() == []
