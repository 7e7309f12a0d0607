from trawl.operators import ml as M


def test_a_user_who_has_had_most_items_gets_the_others(spark):
    had = {1: range(110), 2: range(60), **{u: range(u, u + 12) for u in range(3, 40)}, 40: range(119), 41: range(108, 120)}
    r = spark.createDataFrame([(u, i) for u, items in had.items() for i in items for _ in range(1 + (u < 3))], "user_id long, item int")
    got = {}
    for x in M.recommendations(r, r.select("user_id")).collect():
        got.setdefault(x.user_id, set()).add(x.item)
    assert all(len(got[u]) == min(10, 120 - len(items)) and not got[u] & set(items) for u, items in had.items())
