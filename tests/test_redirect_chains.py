from mossgrid.plans import registry


def test_every_site_and_the_limit_of_hops(spark, tmp_path):
    names = [f"s{i:02}.example" for i in range(30)]
    spark.createDataFrame([(n,) for n in names], "site string").write.parquet(f"{tmp_path}/sites.parquet")
    got = {r["url"]: r["final_url"] for r in registry.queries()["redirect_chains"](spark, str(tmp_path)).collect()}
    ends = [12] * 13 + [25] * 13 + [29] * 4
    assert got == {n: names[e] if e - i <= 10 else None for i, (n, e) in enumerate(zip(names, ends))}
