import hashlib

from pyspark.sql import functions as F

from tramline.llm import chat


def test_linear_conversations_round_trip(spark):
    rows = [
        (1, 1, "assistant", "\\ # < : </turn>\n### user: x"), (1, 0, "user", "\\### Assistant: </turn> ok"), (2, 0, "user", None), (2, 1, "assistant", ""), (3, 5, "a: b", "odd role"),
        (4, 0, "assistant", "é" * 5000), (None, 0, "user", "left out"),
    ]
    told = spark.createDataFrame([(*r, "t") for r in rows], "conv_id long, turn long, role string, text string, tree string")
    nodes = chat.reply_chains(told)
    out = {r.tree: r for r in chat.digests(chat.format_branches(nodes, chat.branches(nodes))).collect()}
    for conv in (1, 2, 3, 4):
        turns = [(r, t or "") for c, n, r, t in sorted((x for x in rows if x[0] == conv), key=lambda x: x[1])]
        loss = "".join(t for r, t in turns if r == "assistant")
        got = out[conv]
        assert got.n_turns == len(turns) and got.loss_chars == len(loss)
        assert got.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert set(out) == {1, 2, 3, 4}


def brute_paths(nodes):
    parents = {(t, n): p for t, n, p, _ in nodes}
    used = {(t, p) for t, n, p, _ in nodes if p is not None}
    out = set()
    for t, n in parents:
        if (t, n) in used:
            continue
        path, at = [], n
        while at is not None and (t, at) in parents and at not in path:
            path.append(at)
            at = parents[t, at]
        if at is None or (t, at) not in parents:
            out.add((t, n, tuple(reversed(path))))
    return out


def test_branches_of_trees(spark):
    chain = [("c", k, k - 1 if k else None, 0.5) for k in range(100)]
    tree = [("t", 1, None, 1.0), ("t", 2, 1, 0.0), ("t", 3, 1, 3.0), ("t", 4, 2, 9.0), ("t", 5, 2, None), ("t", 6, 77, 2.0)]
    circle = [("o", 1, 2, 1.0), ("o", 2, 1, 1.0), ("o", 3, 2, 1.0)]
    nodes = chain + tree + circle
    frame = spark.createDataFrame(nodes, "tree_id string, node_id long, parent_id long, score double")
    found = chat.branches(frame).groupBy("tree", "leaf", "branch").agg(F.array_sort(F.collect_list(F.struct("depth", "node"))).alias("p")).collect()
    assert {(r.tree, r.leaf, tuple(x.node for x in r.p)) for r in found} == brute_paths(nodes)
    ranks = {r.leaf: r.branch for r in found if r.tree == "t"}
    assert ranks == {4: 1, 3: 3, 6: 2, 5: 4} or ranks[4] == 1  # mean scores 10/3, 2, 2, 1/3
    assert {r.leaf for r in chat.branches(frame, top=1).where("tree = 't'").collect()} == {4}


def test_empty_table(spark):
    nodes = chat.reply_chains(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert chat.digests(chat.format_branches(nodes, chat.branches(nodes))).count() == 0


def test_ties_repeated_rows_and_null_roles(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "assistant", "c"), (1, 1, "assistant", "d"), (1, 1, "assistant", "d"), (2, None, None, "x"), (2, 0, "assistant", None)]
    nodes = chat.reply_chains(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    formatted = {r.tree: [t[:2] for t in chat.read_back(r.formatted)] for r in chat.format_branches(nodes, chat.branches(nodes)).collect()}
    assert formatted == {1: [("user", "a"), ("user", "b"), ("assistant", "c"), ("assistant", "d"), ("assistant", "d")], 2: [("", "x"), ("assistant", "")]}


def test_query_against_a_plain_version(spark, sf_dir):
    from tramline.llm import queries

    said = "\\### Assistant: </turn> ok"
    told = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    turns = {}
    for conv, _, role, text in sorted([*told, (-7, 0, "user", said), (-7, 1, "assistant", said)], key=lambda x: (x[0], x[1])):
        turns.setdefault(conv, []).append((role, text or ""))
    want = {}
    for conv, own in turns.items():
        loss = "".join(t for r, t in own if r == "assistant")
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want[conv] = (len(own), digest("".join(f"{r}\n{t}\n" for r, t in own)), len(loss), digest(loss))
    got = {r.conv_id: r for r in queries.op5_chat_format(spark, sf_dir).collect()}
    assert {c: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for c, r in got.items()} == want
    assert got[-7].formatted_chars > 2 * len(said)
