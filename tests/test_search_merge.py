"""The merge of sites' hits against a loop over sites and hits."""

import collections
import random

from brigade.operators import search


def loop(hits, per_site, total):
    results, seen = [], set()
    sites = collections.defaultdict(list)
    for rank, pos, url in hits:
        sites[rank].append((pos, url))
    for rank in sorted(sites):
        added = 0
        for _, url in sorted(sites[rank]):
            if added >= per_site or len(results) >= total:
                break
            if url in seen:
                continue
            seen.add(url)
            results.append((rank, url))
            added += 1
    return results


def test_sites_that_share_urls(spark):
    random.seed(12)
    kind = "query_id long, site_rank int, pos long, url string, name string, source_name string"
    for per_site, total in ((5, 10), (2, 3), (1, 100), (3, 7)):
        hits = {q: [(r, p, f"https://x/{random.randint(0, random.choice([3, 12, 40]))}") for r in range(5) for p in range(random.randint(0, 25))] for q in range(25)}
        rows = [(q, r, p, u, None, f"s{r}") for q, h in hits.items() for r, p, u in h]
        random.shuffle(rows)
        t = spark.createDataFrame(rows, kind)
        got = collections.defaultdict(list)
        for r in search.search_merge(t, per_site=per_site, total=total, query="query_id").orderBy("query_id", "rank").collect():
            got[r.query_id].append((r.site_rank, r.url))
        assert got == {q: x for q, h in hits.items() if (x := loop(h, per_site, total))}
        one = search.search_merge(t.where("query_id = 3").drop("query_id"), per_site=per_site, total=total).orderBy("rank").collect()
        assert [(r.site_rank, r.url) for r in one] == loop(hits[3], per_site, total) and [r["rank"] for r in one] == list(range(1, len(one) + 1))
    assert search.search_merge(t.limit(0), query="query_id").count() == 0
    assert search.search_merge(t.limit(0).drop("query_id")).count() == 0
