import random

from pyspark.sql import functions as F

from verbaloom.llm import op09_url_filter as U


def test_many_nested_rules_of_one_site(spark):
    """Thousands of rules of one site, nested up to a hundred deep, against the longest prefix by hand."""
    rng = random.Random(9)
    paths = {"/" + "x/" * k for k in range(100)} | {"/" + "".join(rng.choice("xyz/") for _ in range(rng.randint(0, 9))) for _ in range(3000)} | {""}
    verdict = {p: rng.choice(["allow", "block"]) for p in paths}
    rules = [("a.org", p, v) for p, v in verdict.items()] + [("a.org", "/xy", v) for v in ("allow", "block")]
    verdict["/xy"] = "block"
    tried = ["/" + "x/" * rng.randint(0, 120) + rng.choice(["", "y", "ü"]) for _ in range(60)] + ["/" + "".join(rng.choice("xyz/w") for _ in range(rng.randint(0, 12))) for _ in range(400)] + [""]
    pages = spark.createDataFrame([(i, f"http://{'w.' * (i % 2)}a.org{p}") for i, p in enumerate(tried)], "page_id long, url string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    for i, p in enumerate(tried):
        assert p == "" or p[0] == "/", i
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in U.url_filter(pages, table).collect()}
    longest = [max((q for q in verdict if p.startswith(q)), key=len) for p in tried]
    assert got == {i: ("a.org" + q, verdict[q]) for i, q in enumerate(longest)}
    assert U.segments(table).filter(F.length("border") == 0).count() == 1
