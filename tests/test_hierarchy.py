import datetime
import random

from kasane.operators import hierarchy

LINK, NODE = "revision_relation_id long, from_revision_id long, to_revision_id long, kind string, depth long", "revision_id long, root string"


def brute(parent):
    out = {}
    for v in parent:
        path, u = [v], v
        while u in parent and parent[u] not in path:
            u = parent[u]
            path.append(u)
        if u in parent:
            circle = path[path.index(parent[u]) :]
            out[v] = (min(circle), -1 if v in circle else -2, None)
        else:
            out[v] = (u, len(path) - 1, "/".join(map(str, reversed(path))))
    return out


def forest(seed, n):
    rnd = random.Random(seed)
    ids = rnd.sample(range(10 * n), n)
    parent = {}
    for i, v in enumerate(ids[1:], 1):
        r = rnd.random()
        if r < 0.03:
            continue
        parent[v] = ids[0] if r < 0.35 else ids[max(0, i - rnd.randint(1, 3))]
    for a in range(5, n, max(7, n // 6)):  # close some circles
        parent[ids[a]] = ids[min(n - 1, a + rnd.randint(0, 3))]
    return ids, parent


def links(spark, ids, parent):
    rnd = random.Random(1)
    rows = []
    for v, p in parent.items():
        rows.append((len(rows), v, p, rnd.choice(["parent", " Parent", "PARENT "]), 1) if rnd.random() < 0.8 else (len(rows), p, v, "child", 1))
        if rnd.random() < 0.2:
            rows.append((len(rows), v, p, "parent", 1))
    rows += [(9000, ids[0], -5, "parent", 1), (9001, -6, ids[0], "parent", 1), (9002, ids[1], ids[2], "amended_to", 1), (9003, None, ids[0], "parent", 1), (9004, ids[0], ids[1], None, 1)]
    return spark.createDataFrame(rows, LINK), spark.createDataFrame([(i, "x") for i in ids] + [(None, "x")], NODE)


def test_equal_brute_force(spark):
    ids, parent = forest(3, 160)
    rel, rev = links(spark, ids, parent)
    want = brute(parent)
    assert {r.revision_id: (r.root_revision_id, r.depth) for r in hierarchy.revision_depths(rel, rev).collect()} == {v: w[:2] for v, w in want.items()}
    assert {r.revision_id: r.path for r in hierarchy.revision_paths(rel, rev).collect()} == {v: w[2] for v, w in want.items() if w[2]}


def test_intervals(spark):
    ids, parent = forest(4, 120)
    rel, rev = links(spark, ids, parent)
    below = {}
    for v, (root, depth, path) in brute(parent).items():
        if path:
            for u in map(int, path.split("/")[:-1]):
                below.setdefault(u, set()).add(v)
    spans = {r.revision_id: r for r in hierarchy.revision_descendants(rel, rev).collect()}
    for u, s in spans.items():
        inside = {v for v, o in spans.items() if o.root_revision_id == s.root_revision_id and s.tin < o.tin <= s.tout}
        assert inside == below.get(u, set()) and s.n_descendants == len(inside)


def test_shapes(spark):
    chain = {i: i + 1 for i in range(40)}
    rel, rev = links(spark, list(range(41)), chain)
    assert {r.depth for r in hierarchy.revision_depths(rel, rev).collect()} == set(range(1, 41))
    own = spark.createDataFrame([(1, 7, 7, "parent", 0), (2, 8, 7, "parent", 0), (3, 9, 1, "parent", 0), (4, 9, 2, "parent", 0)], LINK)
    rev = spark.createDataFrame([(i, "x") for i in range(10)], NODE)
    assert {tuple(r) for r in hierarchy.revision_depths(own, rev).collect()} == {(7, 7, -1), (8, 7, -2), (9, 1, 1)}
    none = spark.createDataFrame([], LINK)
    assert hierarchy.revision_depths(none, rev).count() == 0 and hierarchy.revision_descendants(none, rev).count() == 0


RECORD = "release_id string, scheme string, edition string, normalized_code string, relations array<struct<type:string,scheme:string,code:string,edition:string>>, loaded_at timestamp"


def test_records_of_all_releases(spark):
    """A tree that is gone in the last release, a circle only in the first, a superseded parent, codes with separators."""
    day = datetime.datetime(2024, 1, 1)
    row = lambda release, code, *up, at=0: (release, "ipc", None, code, [(" Parent", "ipc", u, "") for u in up] + [("see", "ipc", "B", "")], day + datetime.timedelta(at))
    rows = [
        row("R1", "A"), row("R1", "b/1", "a"), row("R1", "C|x", "B/1"), row("R1", "D", "A", "zz"), row("R1", "E", "F"), row("R1", "F", "E"), row("R1", "G", "F"),
        row("R2", "A"), row("R2", "E", "A"), row("R2", "F", "E", at=1), row("R2", "F", "A"), row("R2", "B", "D"),
    ]
    got = {(r.release_id, r.record[5:]): r for r in hierarchy.record_hierarchy(spark.createDataFrame(rows, RECORD)).collect()}
    assert {k: (r.root_record[5:], r.depth, r.path and [p[5:] for p in r.path]) for k, r in got.items()} == {
        ("R1", "A"): ("A", 0, ["A"]), ("R1", "B/1"): ("A", 1, ["A", "B/1"]), ("R1", "C|X"): ("A", 2, ["A", "B/1", "C|X"]), ("R1", "D"): ("A", 1, ["A", "D"]),
        ("R1", "E"): ("E", -1, None), ("R1", "F"): ("E", -1, None), ("R1", "G"): ("E", -2, None),
        ("R2", "A"): ("A", 0, ["A"]), ("R2", "E"): ("A", 1, ["A", "E"]), ("R2", "F"): ("A", 2, ["A", "E", "F"]), ("R2", "B"): ("B", 0, ["B"]),
    }
    for (release, code), r in got.items():
        inside = {c for (x, c), o in got.items() if x == release and r.tin and o.tin and o.root_record == r.root_record and r.tin < o.tin <= r.tout}
        assert inside == {c for (x, c), o in got.items() if x == release and c != code and o.path and r.record in o.path}
        assert (r.tin is None) == (r.depth < 0)


def test_every_revision_with_path_and_interval(spark):
    ids, parent = forest(5, 100)
    ids.append(99999)  # without links
    rel, rev = links(spark, ids, parent)
    want = {v: (v, 0, [v]) for v in ids} | {v: (r, d, p and [int(x) for x in p.split("/")]) for v, (r, d, p) in brute(parent).items()}
    got = {r.revision_id: r for r in hierarchy.revision_hierarchy(rel, rev).collect()}
    assert {v: (r.root_revision_id, r.depth, r.path) for v, r in got.items()} == want
    for v, r in got.items():
        assert (r.tin is None) == (r.depth < 0)
        inside = {u for u, o in got.items() if r.tin and o.tin and o.root_revision_id == r.root_revision_id and r.tin < o.tin <= r.tout}
        assert inside == {u for u, (_, _, p) in want.items() if p and v in p[:-1]}
