from stepweave.llm import urls


def test_index_of_a_long_list(tmp_path):
    own = [f"host{i}.example{i % 97}.net" for i in range(200_000)]
    path = tmp_path / "long.idx"
    path.write_bytes(urls.build_index(own))
    index = urls.DigestArray(str(path))
    assert index.size == len(own)
    assert (index.find([x.encode() for x in own]) >= 0).all()
    assert not (index.find([b"x" + x.encode() for x in own[:20_000]]) >= 0).any()


def test_long_hosts_take_few_probes(spark):
    host = "a." * 200_000 + "example.org"
    assert len(urls.suffixes(host, 24)) <= 24 and urls.suffixes("x.org", 40) == ["x.org", "org"]
    df = spark.createDataFrame([(1, f"http://{host}/es/1"), (2, f"http://{host}/de"), (2, f"http://{host}/de"), (3, None)], "page_id long, url string")
    rules = (("org", "/", "allow"), ("example.org", "/es/", "block"))
    for limit in (256 << 20, 0):
        got = sorted((r["page_id"], r["rule"], r["verdict"]) for r in urls.filter_urls(df, rules, max_index_bytes=limit).select("page_id", "rule", "verdict").collect() if r["page_id"] < 3)
        assert got == [(1, "example.org/es/", "block"), (2, "org/", "allow"), (2, "org/", "allow")]
    assert urls.filter_urls(df.limit(0), rules).count() == 0
