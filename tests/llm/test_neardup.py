import itertools
import random

import pytest

from panelwright.llm import components as stars, neardup, queries
from panelwright.llm.common import words_of
from panelwright.llm.components import components


def brute(rows, percent=85):
    """Components of all pairs by full sets."""
    sets = []
    for _, text in rows:
        w = words_of(text)
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    low = {}
    for k, (doc, _) in enumerate(rows):
        low[find(k)] = min(low.get(find(k), doc), doc)
    return sorted((doc, len(sets[k]), low[find(k)], doc == low[find(k)]) for k, (doc, _) in enumerate(rows))


def test_whole_table(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in queries.QUERIES["op6_minhash_near_duplicates"](spark, small).collect())
    assert got == brute(docs)


def test_chains_of_edits_and_copies(spark, documents):
    """A chain in which neighbours are linked and the ends are not, a star of copies, and short texts."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(1000)}" for _ in range(120)]
    texts = []
    for step in range(12):
        texts.append(" ".join([f"n{step}x{k}" for k in range(step)] + base[step:]))
    texts += [" ".join(base).upper()] * 7
    for _ in range(40):
        words = list(base)
        for _ in range(rng.randrange(0, 4)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    texts += ["", None, " \n", "a b", "A  b", "a b c d e", "a b c d e f"]
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [(i * 3, texts[k]) for i, k in enumerate(order)]
    docs = documents([t for _, t in rows], ids=[i for i, _ in rows], extra=True)
    got = sorted(tuple(r) for r in neardup.near_duplicates(docs).collect())
    assert got == brute(rows)


def test_null_and_repeated_rows(spark, documents):
    text = "one two three four five six seven"
    rows = neardup.near_duplicates(documents([text, text, text, "other words", "other words"], ids=[None, 4, 4, 9, 7])).collect()
    assert sorted((str(r.doc_id), r.component_id, r.kept) for r in rows if r.doc_id) == [("4", 4, True), ("4", 4, True), ("7", 7, True), ("9", 7, False)]
    assert [(r.component_id, r.kept) for r in rows if r.doc_id is None] == [(None, True)]
    assert neardup.near_duplicates(documents([])).count() == 0


def test_ids_under_several_texts_and_ids_of_other_types(spark, documents):
    """Each text has the component of its own, also where ids repeat; every text has a kept row that resembles it."""
    rng = random.Random(9)
    families = [[f"f{k}w{rng.randrange(50)}" for _ in range(60)] for k in range(6)]
    rows = []
    for k in range(90):
        words = list(rng.choice(families))
        words[rng.randrange(len(words))] = f"e{rng.randrange(4)}"
        rows.append((k % 20, " ".join(words)))
    rows += [(1, "a b c d e f"), (1, "g h i j k l m"), (2, "g h i j k l m"), (2, "G H i j k l m"), (3, ""), (3, None)]
    want = brute(rows)
    for kind in ("long", "string"):
        docs = spark.createDataFrame([(i if kind == "long" else f"id{i:02d}", t) for i, t in rows], f"doc_id {kind}, text string")
        name = (lambda i: i) if kind == "long" else (lambda i: f"id{i:02d}")
        key = lambda r: tuple(map(str, r))
        assert sorted(map(tuple, neardup.near_duplicates(docs).collect()), key=key) == sorted(((name(d), n, name(c), k) for d, n, c, k in want), key=key)
    kept = neardup.survivors(docs).collect()
    marked = {(r.doc_id, r.mark): r.text for r in docs.withColumn("mark", neardup.text_mark()).collect()}
    alive = [marked[r.doc_id, r.mark] for r in kept]
    sets = lambda t: {tuple(words_of(t)[k : k + 5]) for k in range(max(1, len(words_of(t)) - 4))}
    assert len(kept) == len({r for r in kept}) and None in alive and "" in alive
    texts = [t for t in alive if t]
    assert "a b c d e f" in texts and sum(t.lower() == "g h i j k l m" for t in texts) == 1
    assert all(100 * len(sets(a) & sets(b)) < 85 * len(sets(a) | sets(b)) for a, b in itertools.combinations(texts, 2))


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + k, 101 + k) for k in range(30)] + [(200, 200 + k) for k in range(1, 20)] + [(None, 1), (5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    low = {x: x for e in edges if None not in e for x in e}
    for _ in range(100):
        for a, b in edges:
            if a is not None:
                low[a] = low[b] = min(low[a], low[b])
    assert got == {x: m for x, m in low.items() if any(x in e and e[0] != e[1] and None not in e for e in edges)}


def test_no_table_that_grows_with_the_documents_is_broadcast(spark, monkeypatch):
    """Tables of any size look small to Spark here, as compressed files and exploded rows do at half a gigabyte."""
    plans = []
    real = neardup.cut_lineage

    def note(df, name="cut"):
        plans.append((name, df._jdf.queryExecution().sparkPlan().toString()))
        return real(df, name)

    for module in (neardup, stars):
        monkeypatch.setattr(module, "cut_lineage", note)
    words = [f"w{k}" for k in range(60)]
    docs = spark.createDataFrame([(k, " ".join([*words[:30], f"x{k % 7}", *words[30:]])) for k in range(20)], "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        plans.append(("out", neardup.near_duplicates(docs)._jdf.queryExecution().sparkPlan().toString()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(plans) > 10 and any("SortMergeJoin" in p for _, p in plans)
    assert not [n for n, p in plans if "Broadcast" in p]
