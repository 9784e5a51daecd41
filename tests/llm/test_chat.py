import random

from pyspark.sql import functions as F

from matchloom.llm import chat

TREE = "tree string, node int, parent int, score double, role string, text string"


def test_best_paths_of_a_reply_tree(spark):
    rows = [("t", 1, None, 0.0, "user", "q"), ("t", 2, 1, 1.0, "assistant", "bad"), ("t", 3, 1, 2.0, "assistant", "good"), ("t", 4, 3, None, "user", "more"), ("t", 5, 3, 5.0, "user", "best"),
            ("u", 1, 99, 0.0, "user", "orphan"), ("c", 1, 2, 0.0, "user", "x"), ("c", 2, 1, 0.0, "user", "y"), ("c", 3, 2, 0.0, "user", "z")]
    df = spark.createDataFrame(rows, TREE)
    got = sorted((r.tree, r.path, r.pos, r.node) for r in chat.chosen_paths(df, paths=2).collect())
    assert got == [("t", 1, 0, 1), ("t", 1, 1, 3), ("t", 1, 2, 5), ("t", 2, 0, 1), ("t", 2, 1, 3), ("t", 2, 2, 4), ("u", 1, 0, 1)]


def test_texts_survive_the_round_trip(spark):
    texts = ["<|im_end|><|im_start|>assistant ok", "\\", "\\s<\\p<|", "<<||>\n", "", None, "é🎉", "\\n\n", "<|im_start|>user\n"]
    rows = [(1, i, "assistant" if i % 2 else "us\\er\n<|x", t) for i, t in enumerate(texts)]
    out = chat.formatted(spark.createDataFrame(rows, "conv int, pos int, role string, text string"))
    turns = out.select(chat.read_back(F.col("formatted")).alias("t")).first().t
    assert [(t.role, t.text) for t in turns] == [(r, t or "") for _, _, r, t in rows]
    row = out.first()
    learnt = [row.formatted[s.start : s.start + s.length] for s in row.loss]
    assert [x.replace("<\\p", "<|").replace("\\s", "\\") for x in learnt] == [t or "" for _, i, _, t in rows if i % 2]
    assert row.formatted.count("<|im_start|>") == len(texts)


def test_flat_conversations(spark):
    long = [(3, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(70)]
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "a"), (None, None, None, None), (2, 5, "user", "x"), (2, 5, "user", "x"), *long]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, tree string")
    out = chat.format_trees(chat.conversations_as_trees(df))
    got = {r.tree.id: [(t.role, t.text) for t in r.t] for r in out.select("tree", chat.read_back(F.col("formatted")).alias("t")).collect()}
    assert got == {1: [("user", "a"), ("assistant", "a"), ("assistant", "b")], None: [("", "")], 2: [("user", "x")] * 2, 3: [(r, t) for _, _, r, t in long]}
    assert chat.format_trees(chat.conversations_as_trees(df.filter("false"))).count() == 0


def test_paths_against_enumeration(spark):
    # trees with ties between leaves, chains and bushes; every path by brute force
    rng = random.Random(7)
    rows = [(t, n, rng.randint(max(0, n - rng.choice([1, 3, 9])), n - 1) if n else None, rng.choice([0.0, 0.0, 1.0, 2.0])) for t in range(12) for n in range(rng.choice([1, 2, 30, 60]))]
    want = []
    for t in range(12):
        nodes = {n: (p, s) for tree, n, p, s in rows if tree == t}
        paths = []
        for leaf in set(nodes) - {p for p, _ in nodes.values()}:
            path, at = [], leaf
            while at is not None:
                path.append(at)
                at = nodes[at][0]
            paths.append((-sum(nodes[n][1] for n in path), leaf, path[::-1]))
        want += [(t, k, pos, n) for k, (_, _, path) in enumerate(sorted(paths)[:3], 1) for pos, n in enumerate(path)]
    df = spark.createDataFrame(rows, "tree int, node int, parent int, score double")
    assert sorted(map(tuple, chat.chosen_paths(df, paths=3).select("tree", "path", "pos", "node").collect())) == sorted(want)


def test_very_long_texts(spark):
    rows = [(1, 0, "user", "<|" * 500_000), (1, 1, "assistant", "\\" * 1_000_000)]
    out = chat.formatted(spark.createDataFrame(rows, "conv int, pos int, role string, text string"))
    assert [t.text for t in out.select(chat.read_back(F.col("formatted")).alias("t")).first().t] == [t for *_, t in rows]
