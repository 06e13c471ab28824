import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from llm_cases import SMALL

from quillon.llm import registry
from quillon.llm.prefix_trie import digest_trie, prefix_trie, shared_starts, turn_digests

SCHEMA = "conv_id long, turn long, role string, text string"


def digest_of(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]


def conversations(rows):
    """conv_id -> its turns in order, as (role, text)."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            out[conv].append((turn is not None, turn or 0, digest_of(role or "", text or ""), role or "", text or ""))
    return {c: [t[3:] for t in sorted(v)] for c, v in out.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = convs.get(c - c % 100, [])[:h] + own[h:]
    return out


def brute(convs):
    """The nodes from their definition, by sets of members and walks over all nodes."""
    members = defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
    rows = []
    for path, own in members.items():
        under = [p for p in members if p[: len(path)] == path]
        has_child = {p[:-1] for p in under if p}
        ends = ",".join(str(c) for c in sorted(own) if len(convs[c]) == len(path))
        rows.append(
            (
                min(own),
                len(path),
                min(members[path[:-1]]) if path else None,
                len(own),
                sum(len(p) == len(path) + 1 for p in under),
                sum(p not in has_child for p in under),
                sum((len(members[p]) - 1) * len(p[-1][1]) for p in under if p),
                hashlib.sha256(ends.encode()).hexdigest(),
            )
        )
    return sorted(rows, key=str)


def got(df):
    names = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    return sorted((tuple(r) for r in df.select(*names).collect()), key=str)


def random_rows(seed, convs, deepest, choices):
    rng = random.Random(seed)
    return [(rng.choice([c, -c]), t, rng.choice(["user", "bot"][:choices]), "x" * rng.randrange(choices) + "é") for c in range(convs) for t in range(rng.randrange(deepest))]


@pytest.mark.parametrize("seed,convs,deepest,choices", [(1, 40, 6, 1), (2, 60, 8, 2), (3, 200, 4, 3), (4, 15, 30, 1)])
def test_equals_brute_force(spark, seed, convs, deepest, choices):
    rows = random_rows(seed, convs, deepest, choices)
    assert got(prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(3))) == brute(conversations(rows))


def test_rebuilt_conversations(spark):
    rng = random.Random(5)
    rows = [(c, t, "u", rng.choice("ab")) for c in [*range(-120, 130), 250, 999] for t in range(rng.randrange(1, 9)) if c not in (100,)]
    df = shared_starts(turn_digests(spark.createDataFrame(rows, SCHEMA)))
    found = digest_trie(df, spark.createDataFrame(rows, SCHEMA).select("conv_id"))

    def truncated(c):
        return c - (c % 100 if c >= 0 else -(-c % 100))

    convs = conversations(rows)
    want = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        want[c] = convs.get(truncated(c), [])[:h] + own[h:]
    assert any(not t for t in want.values())
    assert got(found) == brute(want)


def test_query_on_sample_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(registry.op11_prefix_trie(spark, SMALL)) == brute(rebuilt(conversations(rows)))


def test_query_equals_sql(spark):
    import check_oracle

    assert check_oracle.difference(spark, check_oracle.duck(SMALL), "op11_prefix_trie", SMALL) == ""


def test_edges(spark):
    """Nulls anywhere, tied and repeated turns, empty texts, clashing columns, no rows."""
    rows = [
        (1, None, None, None), (1, 0, "u", ""), (1, 0, "u", ""), (1, 0, "a", "tie"), (2, None, "", ""), (2, 0, "u", ""),
        (None, 0, "u", "lost"), (None, None, None, None), (3, None, "u", "x"), (3, None, "u", "w"), (3, 5, "u", "x"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(conversations(rows))
    assert got(prefix_trie(df)) == want
    assert got(prefix_trie(df.selectExpr("*", "1 AS depth", "2 AS owner", "3 AS digest", "4 AS n_convs"))) == want
    assert got(prefix_trie(spark.createDataFrame([], SCHEMA))) == []
    lone = spark.createDataFrame([(9,), (None,), (4,), (9,)], "conv_id long")
    assert got(prefix_trie(spark.createDataFrame([], SCHEMA), lone)) == brute({4: [], 9: []})


def test_one_long_conversation_and_many_copies(spark):
    long = [(0, t, "u", "deep") for t in range(700)]
    copies = [(c, t, "u", "deep") for c in range(1, 400) for t in range(3)]
    found = got(prefix_trie(spark.createDataFrame(long + copies, SCHEMA)))
    assert len(found) == 701
    by_depth = {r[1]: r for r in found}
    assert by_depth[3][3:7] == (400, 1, 1, 399 * 4) and by_depth[0][6] == 3 * 399 * 4 and by_depth[700][4:6] == (0, 1)
    assert by_depth[3][7] == hashlib.sha256(",".join(map(str, range(1, 400))).encode()).hexdigest()
    assert by_depth[5][7] == hashlib.sha256(b"").hexdigest()


def test_pieces_of_ids_join_in_numeric_order(spark, monkeypatch):
    from quillon.llm import prefix_trie as module

    monkeypatch.setattr(module, "PIECE_IDS", 3)
    rows = [(c, 0, "u", "same") for c in range(-30, 120)]
    assert got(prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(4))) == brute(conversations(rows))
