import random
from collections import Counter

import pytest

from sharelens.operators import links, membership

COLUMNS = "author string, host string, subreddit string, url string, id string, score int"


def comments(spark, rows):
    full = [(a, h, s, f"http://{h}", str(i), 1) for i, (a, h, s) in enumerate(rows)]
    return spark.createDataFrame(full, COLUMNS)


def test_pair_limit_keeps_light_posters(spark):
    df = comments(spark, [("a", "h", "s")] * 19 + [("b", "h", "s")] * 20)
    kept = links.drop_heavy_pairs(df, links.heavy_pairs(df, 20))
    assert {r.author for r in kept.collect()} == {"a"}
    assert kept.count() == 19


def test_keys_do_not_collide_and_null_authors_stay(spark):
    df = comments(spark, [("a_b", "c", "s")] + [("a", "b_c", "s")] * 20 + [(None, "h", "s")] * 2)
    kept = links.drop_heavy_pairs(df, links.heavy_pairs(df, 20)).collect()
    assert Counter((r.author, r.host) for r in kept) == {("a_b", "c"): 1, (None, "h"): 2}


def test_null_author_can_be_heavy(spark):
    df = comments(spark, [(None, "h", "s")] * 3 + [(None, None, "s")] * 3 + [("x", None, "s")])
    kept = links.drop_heavy_pairs(df, links.heavy_pairs(df, 3)).collect()
    assert [(r.author, r.host) for r in kept] == [("x", None)]


def test_site_hosts(spark):
    hosts = ["reddit.com", "old.reddit.com", "new.reddit.com", "np.reddit.com", "i.redd.it", None]
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    assert sorted(r.host for r in links.drop_site_hosts(df).collect()) == ["i.redd.it", "np.reddit.com"]


@pytest.mark.parametrize("broadcast_pairs", [1_000_000, 0])
def test_counts_match_brute_force_on_skewed_input(spark, monkeypatch, broadcast_pairs):
    """A third of the posts share one author and host; both join ways agree."""
    monkeypatch.setattr(links, "MAX_BROADCAST_PAIRS", broadcast_pairs)
    rng = random.Random(3)
    rows = [("bot", "hot.com", f"s{rng.randint(0, 5)}") for _ in range(300)]
    rows += [(f"a{rng.randint(0, 40)}", f"h{rng.randint(0, 9)}", f"s{rng.randint(0, 9)}") for _ in range(600)]
    df = comments(spark, rows)
    pair = Counter((a, h) for a, h, _ in rows)
    light = [r for r in rows if pair[r[0], r[1]] < 4]
    assert {(r["host"], r["subreddit"]): r["count"] for r in links.host_sub_counts(df, 4).collect()} == Counter(
        (h, s) for _, h, s in light
    )
    totals = Counter(h for _, h, _ in light)
    posts = links.select_link_posts(df, pair_limit=4, host_floor=30)
    assert Counter(r.host for r in posts.collect()) == {h: n for h, n in totals.items() if n > 30}


def test_select_link_posts_uses_allow_list_and_meta(spark):
    df = comments(spark, [(f"a{i}", h, "s") for i in range(5) for h in ("x", "y", "reddit.com")])
    meta = spark.createDataFrame([("x", 1), ("reddit.com", 2)], "host string, labels int")
    allowed = spark.createDataFrame([("x",), ("reddit.com",)], "host string")
    posts = links.select_link_posts(df, meta, allowed, 20, 4).collect()
    assert len(posts) == 5 and {(r.host, r.labels) for r in posts} == {("x", 1)}


def test_top_hosts_breaks_ties_by_name(spark):
    counts = spark.createDataFrame([("b", "s", 2), ("a", "s", 2), ("c", "s", 5)], "host string, subreddit string, count bigint")
    assert [r.host for r in links.top_hosts(counts, 2).collect()] == ["c", "a"]
    assert {r.host for r in links.counts_of_top_hosts(counts, 2).collect()} == {"c", "a"}


def test_hosts_are_cut_out_of_urls_once_a_row(spark, monkeypatch):
    """Also where the long lists are tried by a Bloom filter, which mentions the host many times."""
    monkeypatch.setattr(links, "keep_listed", lambda df, listed, key, most: membership.keep_listed(df, listed, key, 0))
    rows = [(f"a{i}", f"https://www.h{i % 3}.com/{i}", "s", str(i), 1) for i in range(30)] + [("b", None, "s", "x", 1)]
    df = links.with_host(spark.createDataFrame(rows, "author string, url string, subreddit string, id string, score int"))
    allowed = spark.createDataFrame([("h1.com",), ("h2.com",)], "host string")
    plans, checkpoint = [], type(df).checkpoint
    text = lambda x: x._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(type(df), "checkpoint", lambda x, *args, **kw: plans.append(text(x)) or checkpoint(x, *args, **kw))
    posts = links.select_link_posts(df, None, allowed, 2, 4)
    assert max(p.count("regexp_extract(") for p in [*plans, text(posts)]) == 1
    assert {(r.host, r.id) for r in posts.collect()} == {(f"h{i % 3}.com", str(i)) for i in range(30) if i % 3}
