from lociq.plans import relational_queries as rq
from lociq.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_two_colour_takes_all_orders(spark):
    root: dict = {}

    def find(n):
        while root.setdefault(n, n) != n:
            n = root[n]
        return n

    for o in spark.read.parquet(f"{SF}/orders.parquet").collect():
        a, b = find(o.o_custkey % 300), find(o.o_orderkey % 301 + 300)
        root[max(a, b)] = min(a, b)
    got = QUERIES["g06_two_colour"](spark, SF).collect()
    assert sorted((r.node, r.root) for r in got) == sorted((n, find(n)) for n in root)


def test_reconciled_nests_take_all_elements(spark):
    rows = rq._elements(spark, SF, True).collect()
    root = {r.key: r.key for r in rows}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    ends = lambda r: [(r.start1, r.l_end), (r.r_start, r.end1)]
    for i, a in enumerate(rows):
        for b in rows[:i]:
            if a.seqid == b.seqid and any(s <= v and u <= t for s, t in ends(a) for u, v in ends(b)):
                root[find(a.key)] = find(b.key)
    best: dict = {}
    for r in rows:
        best.setdefault(find(r.key), []).append((-(r.aln * (1 - r.p)), r.key))
    got = {r.key for r in QUERIES["reconciled_nests"](spark, SF).collect()}
    assert got == {min(g)[1] for g in best.values()}
