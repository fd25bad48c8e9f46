import duckdb
import pytest

from panelwright.llm import decontamination, queries


def brute(texts, items, n=10):
    out = []
    wins = {(i, tuple(w[k : k + n])) for i, t in items for w in [decontamination.WORD.findall(decontamination.lower_ascii(t or ""))] if w for k in range(max(1, len(w) - n + 1))}
    for text in texts:
        words = decontamination.WORD.findall(decontamination.lower_ascii(text or ""))
        hit, named = set(), set()
        for i, win in wins:
            for k in range(len(words) - len(win) + 1):
                if tuple(words[k : k + len(win)]) == win:
                    hit.update(range(k, k + len(win)))
                    named |= {str(i)} - {"None"}
        out.append((len(words), len(hit), sorted(named)))
    return out


TEXTS = [None, "", "...", "Alpha BETA gamma", "x alpha, beta; gamma y alpha beta gammas", " ".join(f"w{k}" for k in range(40)), "é É a1 " + " ".join(f"w{k}" for k in range(5, 16)),
         "alpha beta " * 300 + "alpha beta gamma", "w3 w4 w5 w6 w7 w8 w9 w10 w11", "q q q q q q q q q q q q"]
ITEMS = [(1, "alpha beta gamma"), (2, " ".join(f"w{k}" for k in range(3, 25))), (2, "é"), (None, "a1 w5"), (3, None), (4, ""), (5, "!!"), (6, "Alpha-beta-GAMMA"), (7, "q q q q q q q q q q q")]


@pytest.mark.parametrize("block_chars", [4_000_000, 60])
def test_brute_force(spark, documents, block_chars):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = documents(TEXTS, extra=True)
    rows = decontamination.contamination(docs, items, block_chars=block_chars).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_hit, r.item_ids) for r in rows] == brute(TEXTS, ITEMS)
    assert [r.contaminated for r in rows] == [r.n_hit > 0 for r in rows]
    assert [TEXTS[4][s.start : s.end] for s in rows[4].hit_spans] == ["alpha, beta; gamma"]
    assert [TEXTS[6][s.start : s.end] for s in rows[6].hit_spans] == [TEXTS[6]] or rows[6].n_hit == 13


def test_empty_tables(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    rows = decontamination.contamination(documents(["a b"]), none).collect()
    assert [(r.n_words, r.n_hit, r.contaminated) for r in rows] == [(2, 0, False)]
    assert decontamination.contamination(documents([]), none).count() == 0


def test_query_matches_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.QUERIES["op2_decontaminate"](spark, sf)
    want = con.execute(queries.ORACLES["op2_decontaminate"]).fetchall()
    got = [tuple(r) for r in df.collect()]
    assert sorted(got) == sorted(want) and any(r[5] for r in got)
