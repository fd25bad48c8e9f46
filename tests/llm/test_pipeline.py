import re
from collections import defaultdict

import corpus_pipeline
from panelwright.llm import decontamination, pii, quality
from panelwright.llm.common import words_of

SF = "/root/testdata/sf0.001"


def smallest_of_groups(rows):
    """Ids without a similar document of a smaller id in their component, by all pairs."""
    sets = {}
    for doc, text in rows:
        w = words_of(text)
        sets[doc] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    low = {doc: doc for doc in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in range(len(sets)):
        before = dict(low)
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
        if low == before:
            break
    return {doc for doc in sets if low[doc] == doc}


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, texts = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    items = [decontamination.windows(r.text, 10) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {f" {w} " for own in items for w in own}
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality"))
    good = {r.doc_id for r in quality.score(docs, model).where("score >= 0.3").collect()}
    alone = smallest_of_groups([(i, texts[i]) for i in sorted(good)])
    spell = lambda t: f" {' '.join(decontamination.WORD.findall(decontamination.lower_ascii(t)))} "
    clean = {i for i in alone if not any(w in spell(texts[i]) for w in windows)}

    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.cut_lineage(stage(spark, docs, SF), name)
        assert docs.columns == columns
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert kept == [good, alone, clean, clean] and len(clean) < len(alone) < len(good) < len(texts)
    masked = {r.doc_id: r for r in docs.collect()}
    for i in clean:
        assert masked[i].n_chars == len(masked[i].text)
        assert pii.base_spans(masked[i].text) == [] and (pii.base_spans(texts[i]) or re.search(r"\[(EMAIL|IP|CARD|PHONE)\]", masked[i].text) or masked[i].text == texts[i])
    pieces = defaultdict(int)
    for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect():
        pieces[r.doc_id, r.doc_tokens] += r.length
    assert {d for d, _ in pieces} == clean and all(n == total for (_, total), n in pieces.items())


def test_edges(spark, documents):
    docs = documents([None, "", "a b c d e f", "a b c d e f", "a b c d e f", "x@y.com"], ids=[None, 1, 2, 2, 3, None], extra=True)
    once = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert sorted(str(r.doc_id) for r in once.collect()) == ["1", "2", "None", "None"] and once.columns == docs.columns
    clean = corpus_pipeline.drop_contaminated(spark, docs, SF)
    assert clean.columns == docs.columns and clean.count() == 6
    assert corpus_pipeline.mask_personal_data(spark, docs, SF).columns == docs.columns


def test_no_text_is_lost_where_ids_repeat(spark, documents):
    """(1, A), (1, B), (2, B): A and B both stay, once each."""
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    docs = documents([a, b, b, b], ids=[1, 1, 2, 1])
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(1, a), (1, b)]
