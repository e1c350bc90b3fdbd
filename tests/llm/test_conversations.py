import hashlib
import random
import zlib

import pytest

from framelake.llm import conversations as c

from . import plain

SCHEMA = "conv_id long, turn long, role string, text string, depth string, name string, n string, conv string"


def plain_trie(rows, group=5, heads=9):
    """Nodes by a plain walk over all prefixes."""
    sha = lambda r, t: hashlib.sha256(f"{len(r.encode())}:{r}{t}".encode()).hexdigest()
    own = {}
    for i, turn, role, text in sorted(((i, t, r or "", x or "") for i, t, r, x in rows if i is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, sha(*r[2:]))):
        own.setdefault(i, []).append((role, text))
    made = {}
    for i, turns in own.items():
        h = zlib.crc32(str(i).encode()) % heads
        base = i - (abs(i) % group) * (1 if i >= 0 else -1)
        made[i] = own.get(base, [])[:h] + turns[h:]
    members = {}
    for i, turns in made.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(i)
    kids, out = {}, []
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = kids.get(node, [])
        leaves[node] = sum(leaves[k] for k in below) or 1
        saved[node] = sum(saved[k] for k in below) + (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
        ends = hashlib.sha256(",".join(map(str, sorted(i for i in members[node] if len(made[i]) == len(node)))).encode()).hexdigest()
        parent = min(members[node[:-1]]) if node else None
        out.append((min(members[node]), len(node), parent, len(members[node]), len(below), leaves[node], saved[node], ends))
    return out


def awkward():
    rnd = random.Random(3)
    say = lambda: rnd.choice(["hi", "é", "", "you", None, "a long answer " * 30])
    rows = []
    for i in [*range(0, 40), -7, -5, -3, 100, 103, 2**40 + 1]:
        n = rnd.choice([1, 1, 2, 3, 6, 12])
        for t in range(n):
            rows.append((i, None if rnd.random() < 0.1 else t, rnd.choice(["user", "user", None]), say()))
    rows += [(i, t, "user", f"turn {t}") for i in (50, 51, 52, 55, 60, 61, 66) for t in range(30)]  # copies, also over whole groups
    rows += [(55, 30, "user", "more"), (200, 1, "user", "x"), (200, 1, "user", "x"), (200, 1, "assistant", "x"), (None, 0, "user", "lost"), (None, None, None, None)]
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, "d", "n", "m", "c") for r in rows], SCHEMA)


@pytest.mark.parametrize("part,most", [(4096, 1 << 26), (7, 1 << 15), (7, 1)])
def test_trie_equals_a_plain_walk(spark, monkeypatch, part, most):
    monkeypatch.setattr(c, "PART", part)
    rows = awkward()
    got = c.trie(*c.rebuilt(table(spark, rows)), fewest=1, most=most)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert plain.ordered(got.collect()) == plain.ordered(plain_trie(rows))


def test_trie_of_little(spark):
    assert c.prefix_trie(table(spark, [])).count() == 0
    for rows in ([(5, 0, "user", "a")], [(None, 0, "user", "a")], [(3, 0, "user", "a"), (4, 0, "user", "a")]):
        assert plain.ordered(c.prefix_trie(table(spark, rows)).collect()) == plain.ordered(plain_trie(rows))


def test_screen_lets_no_shared_prefix_go(spark):
    rows = spark.range(3000).selectExpr("id AS conv", "1L AS depth", "cast(if(id % 10 = 0, id div 20, id) as string) AS name")
    for most in (1, 1 << 8, 1 << 26):
        got = c.screen(rows, fewest=1, most=most).groupBy("name").agg({"shared": "min", "*": "count"}).collect()
        assert all(r["min(shared)"] for r in got if r["count(1)"] > 1)
        if most == 1 << 26:
            assert sum(not r["min(shared)"] for r in got) > 2000


def test_list_hashes_of_a_long_list(spark):
    rows = spark.range(20_000).selectExpr("if(id % 3 = 0, 'hot', concat('n', id div 100)) AS name", "id - 50 AS conv")
    want = {}
    for r in rows.collect():
        want.setdefault(r["name"], []).append(r["conv"])
    got = {r["name"]: r["ends_sha256"] for r in c.list_hashes(rows).collect()}
    assert got == {k: hashlib.sha256(",".join(map(str, sorted(v))).encode()).hexdigest() for k, v in want.items()}
