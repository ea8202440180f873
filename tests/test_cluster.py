"""JN-07 against an independent sequential walk on random key sets (chains included)."""

import random

from trackwise.operators import cluster
from trackwise.operators.cluster import cluster_keys, similarity_edges


def lev1(a, b):
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    s, t = (a, b) if len(a) < len(b) else (b, a)
    return any(t[:i] + t[i + 1:] == s for i in range(len(t)))


def similar(a, b, m=7):
    if "unknown" in (a, b):
        return False
    return lev1(a, b) or (len(a) >= m and len(b) >= m and (a in b or b in a))


def walk(stats):
    order = sorted(stats, key=lambda k: (-stats[k][0], stats[k][1]))
    leaders, out = [], {}
    for k in order:
        canon = k
        if k != "unknown":
            for lead in leaders:
                if similar(lead, k):
                    canon = lead
                    break
        if canon == k:
            leaders.append(k)
        out[k] = canon
    return out


def random_keys(rng, n):
    base = ["ab", "abc", "abd", "abcd", "bcd", "acme", "acmes", "acne", "unknown", "northwind", "northwinds",
            "northwindsystems", "windsystems", "zeta", "zetas", "zetaa"]
    keys = set(rng.sample(base, rng.randint(5, len(base))))
    while len(keys) < n:
        w = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 5)))
        keys.add(w)
    return sorted(keys)


def test_matches_sequential_walk(spark):
    rng = random.Random(7)
    for trial in range(3):
        keys = random_keys(rng, 40)
        stats = {k: (rng.randint(1, 4), i * 3 + trial) for i, k in enumerate(rng.sample(keys, len(keys)))}
        df = spark.createDataFrame([(k, c, f) for k, (c, f) in stats.items()], "key string, cnt long, first_seen long")
        got = {r["key"]: r["canonical"] for r in cluster_keys(df).collect()}
        assert got == walk(stats), trial


def test_no_cartesian_in_plan(spark):
    """The plan of the candidate pairs themselves, before anything is stored."""
    df = spark.createDataFrame([("acme", 2, 0), ("acmes", 1, 1), ("acmeindustries", 1, 2)], "key string, cnt long, first_seen long")
    edges = similarity_edges(df, 7, 0)
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert {tuple(sorted(r)) for r in edges.select("a", "b").collect()} == {("acme", "acmes")}


def test_long_chain(spark):
    keys = ["a" * n for n in range(1, 25)]  # each is one letter from the next
    stats = {k: (1, i) for i, k in enumerate(keys)}
    df = spark.createDataFrame([(k, c, f) for k, (c, f) in stats.items()], "key string, cnt long, first_seen long")
    assert {r["key"]: r["canonical"] for r in cluster_keys(df, min_contain=99).collect()} == walk_with(stats, 99)


def walk_with(stats, m):
    order, leaders, out = sorted(stats, key=lambda k: (-stats[k][0], stats[k][1])), [], {}
    for k in order:
        out[k] = next((lead for lead in leaders if similar(lead, k, m)), k)
        if out[k] == k:
            leaders.append(k)
    return out


def elect_plainly(edges):
    early = {}
    for a, b in edges:
        early.setdefault(b, set()).add(a)
        early.setdefault(a, set())
    state = {}
    for k in sorted(early):
        state[k] = "F" if any(state[e] == "L" for e in early[k]) else "L"
    return state


def test_chain_of_100000_keys_in_few_rounds(spark, monkeypatch):
    n, rounds = 100_000, []
    keep = cluster.stored
    monkeypatch.setattr(cluster, "stored", lambda df, what: (rounds.append(what), keep(df, what))[1])
    chain = spark.range(n - 1).selectExpr("id AS early", "id + 1 AS late")
    state = cluster.elect(chain)
    assert rounds.count("elect-keys") <= 25
    assert state.count() == n and state.filter("(key % 2 = 0) <> (state = 'L')").isEmpty()


def test_election_on_random_graphs(spark):
    rng = random.Random(3)
    edges, at = [], 0
    for size, per in ((60, 1), (60, 2), (60, 4), (40, 12)):  # trees, then denser and denser
        for k in range(1, size):
            near = range(max(0, k - 8), k)
            edges += [(at + e, at + k) for e in rng.sample(near, min(len(near), rng.randint(1, per)))]
        at += size
    df = spark.createDataFrame(edges, "early long, late long")
    assert {r["key"]: r["state"] for r in cluster.elect(df).collect()} == elect_plainly(edges)


def test_exploded_keys_are_never_gathered_by_the_driver(spark):
    """Variants, parts and grams are many times the key table whose size the planner sees."""
    from trackwise.operators.cluster import new_edges, similarity_edges

    keys = spark.range(300).selectExpr("md5(cast(id as string)) AS key")
    for edges in (similarity_edges(keys), new_edges(keys, keys.filter("key < '4'"))):
        assert "BroadcastHashJoin" not in edges._jdf.queryExecution().executedPlan().toString()
