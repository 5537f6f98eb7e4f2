"""manifest_sequence where several pages have one url: the SQL leaves their order open, here their ids decide."""

import duckdb

from claimloom.plans.catalog import ORACLE_SQL, QUERIES


def test_pages_of_one_url_stand_in_the_order_of_their_ids(spark, tmp_path):
    urls = ["http://a.example/x", "http://a.example/x", "http://a.example/w", "http://a.example/x", "https://a.example/x", "none", "none", None, None]
    pages = [(i, urls[i % len(urls)], "") for i in range(5 * len(urls))]
    for k, rows in enumerate((pages[::-1], pages[::2] + pages[1::2])):
        path = f"{tmp_path}/{k}"
        spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3 + k).write.parquet(f"{path}/pages.parquet")
        got = QUERIES["manifest_sequence"](spark, path).collect()
        at = {(r.host, r.sequence): (r.url or "", r.page_id) for r in got}
        hosts = {host: sorted(v for (h, _), v in at.items() if h == host) for host, _ in at}
        assert len(at) == len(got) == len(pages) and all(at[h, n] == v for h, vs in hosts.items() for n, v in enumerate(vs))
        with duckdb.connect() as con:  # what the SQL does tell: the urls in their order
            con.execute(f"CREATE VIEW pages AS SELECT * FROM '{path}/pages.parquet/*.parquet'")
            want = con.execute(f"SELECT url, host, sequence FROM ({ORACLE_SQL['manifest_sequence']})").fetchall()
        assert sorted(((r.url, r.host, r.sequence) for r in got), key=repr) == sorted(want, key=repr)
