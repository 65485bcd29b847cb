from watchspan.llm import url_trees


def test_rules_hosts_and_paths(spark):
    urls = {1: "http://www.Example.com/en/1?x=/es/", 2: "https://a.example.com/en/x", 3: "http://example.com", 4: "http://net/fr/", 5: "x.net/es/", 6: None,
            7: "http://evilnet/es/", 8: "http://b.net/es/#f", 9: "http://other.org/en", 10: "", 11: "http://example.com/de/", 12: "http://notexample.com/en/"}
    pages = spark.createDataFrame([(k, u, "h") for k, u in urls.items()] + [(1, urls[1], "h")], "page_id long, url string, host string")
    model = url_trees.Model(-1.0, [0.5] * url_trees.BUCKETS, [])
    rows = url_trees.judge(pages, model).collect()
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}
    assert len(rows) == len(urls) + 1
    assert got[1] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert got[2] == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert got[3] == ("example.com", "", None, "allow")
    assert got[4] == ("net", "/fr/", "net/fr/", "block")
    assert got[5] == got[6] == got[10] == ("", "", None, "allow")
    assert got[7] == ("evilnet", "/es/", None, "allow") and got[8][2:] == ("net/es/", "block")
    assert got[11][2:] == ("com/", "allow") and got[12][2:] == ("com/", "allow")


def test_trees_learn_what_is_in_the_url(spark):
    rows = [(f"http://h{k}.org/" + ("a1b2c3d4" * 3 if k % 3 == 0 else "plain/page"), k % 3 == 0) for k in range(300)]
    labelled = url_trees.parts(spark.createDataFrame(rows, "url string, block boolean"))
    model = url_trees.fit(labelled, trees=3, depth=2)
    judged = url_trees.judge(spark.createDataFrame([(f"http://x{k}.net/" + ("z9y8x7w6" * 3 if k % 2 else "some/text"), bool(k % 2)) for k in range(40)],
                                                   "url string, bad boolean"), model, rules=()).collect()
    assert all((r.verdict == "block") == r.bad for r in judged)


def test_no_labels_allow_everything(spark):
    none = url_trees.parts(spark.createDataFrame([], "url string, block boolean"))
    model = url_trees.fit(none)
    assert url_trees.judge(spark.createDataFrame([("http://a.org/x",), (None,)], "url string"), model).select("verdict").distinct().collect()[0].verdict == "allow"
    assert url_trees.judge(spark.createDataFrame([], "url string"), model).count() == 0
