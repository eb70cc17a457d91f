from reviewlens.llm import urls


def judged(spark, rows, edges=None):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as verdict")
    if edges is not None:
        edges = spark.createDataFrame(edges, "url string, target string")
    return {r.page_id: r for r in urls.judge(pages, edges=edges).collect()}


def test_host_path_and_rules(spark):
    got = judged(spark, [
        (1, "HTTP://A.Example.NET/en/x?y#z", ""), (2, "https://net/", None), (3, "https://net", ""), (4, "x.net/a", ""), (5, None, None),
        (6, "http://b.example.com/de/", ""), (7, "http://b.example.com/fr/", ""), (8, "http://a.org/fr/1", ""), (9, "a://b://c.net/d", ""),
        (10, "http://notexample.com/de/", ""), (11, "http://x.net?q=/a", ""), (12, "", ""), (13, "http://É.net/é", ""), (14, "http://example.net/EN/", ""),
    ])
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert (got[2].rule, got[2].verdict) == ("net/", "block")
    assert (got[3].host, got[3].path, got[3].rule, got[3].verdict) == ("net", "", None, "allow")
    assert (got[4].host, got[4].path) == (got[5].host, got[5].path) == (got[12].host, got[12].path) == ("", "")
    assert (got[6].verdict, got[7].verdict, got[8].rule) == ("block", "allow", "org/fr/")
    assert (got[9].host, got[9].path, got[9].rule) == ("b:", "//c.net/d", None)
    assert (got[10].rule, got[11].path, got[11].rule) == (None, "", None)
    assert (got[13].host, got[13].rule, got[14].rule) == ("É.net", "net/", "net/")


def test_aliases_inherit_with_allow_first(spark):
    canonical = '<LINK rel="canonical" href="%s">'
    got = judged(spark, [
        (1, "http://a.xyz/1", canonical % "http://bad.net/1"),
        (2, "https://a.xyz/1#part", ""),
        (3, "http://b.xyz/", "<meta http-equiv='refresh' content=\"0; url=http://a.xyz/1\">"),
        (4, "http://c.xyz/d/e", "<link href=f rel=canonical>"), (5, "http://c.xyz/d/f", canonical % "//bad.net/2"),
        (6, "http://g.xyz/", canonical % "/h"), (7, "http://g.xyz/h", canonical % "http://bad.net/3"), (8, "http://g.xyz/i", canonical % "http://ok.org/fr/"), (9, "http://g.xyz/i", canonical % "/h"),
        (10, "http://bad.net/3", ""), (11, "http://z.xyz/", "<link rel=stylesheet href=http://bad.net/1>"), (12, "http://y.xyz/q?canonical", None),
    ])
    assert [got[k].verdict for k in range(1, 6)] == ["block"] * 5
    assert [got[k].verdict for k in (6, 7, 8, 9)] == ["allow"] * 4
    assert (got[10].verdict, got[10].rule) == ("block", "net/")
    assert got[11].verdict == got[12].verdict == "allow"


def test_long_chain_and_given_edges(spark):
    chain = [(f"http://h{k}.xyz/", f"http://h{k + 1}.xyz/") for k in range(60)] + [("http://h60.xyz/", "http://w.net/"), (None, "http://a.net/"), ("x", "y")]
    got = judged(spark, [(k, f"http://h{k}.xyz", "") for k in range(62)], chain)
    assert all(got[k].verdict == "block" for k in range(61)) and got[61].verdict == "allow"


def test_empty_and_repeated(spark):
    pages = spark.createDataFrame([(1, "http://a.net/", None)] * 3 + [(None, "http://a.net/", "")], "page_id long, url string, html string")
    assert urls.judge(pages.limit(0)).collect() == []
    assert [r.verdict for r in urls.judge(pages).collect()] == ["block"] * 4
