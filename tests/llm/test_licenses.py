import math
import re
import textwrap
from collections import Counter

from panelwright.llm import licenses, queries


def brute(rows, least=0.75):
    """The same scan with dictionaries; rows: (doc_id, path, text)."""
    find = lambda t: re.findall(licenses.TERM, t.lower())
    counts = [(name, Counter(find(t))) for name, t in licenses.TEMPLATES]
    df = Counter(t for _, c in counts for t in c)
    idf = lambda t: math.log((1 + len(counts)) / (1 + df[t])) + 1
    norm = lambda c: math.sqrt(sum((n * idf(t)) ** 2 for t, n in c.items()))
    own, files = {}, {}
    for doc, path, text in rows:
        words, best = 0, None
        for line in (text or "").split("\n"):
            if re.search(licenses.CANDIDATE, line):
                c = Counter(find(line))
                hits = [(-round(sum(n * idf(t) * k[t] * idf(t) for t, n in c.items()) / norm(c) / norm(k), 9), name) for name, k in counts]
                hits = [h for h in hits if -h[0] >= least]
                if hits:
                    words += sum(c.values())
                    best = min([best, min(hits)] if best else [min(hits)])
        own[doc] = best
        if best and 2 * words >= len(find(text)):
            folder = path.rpartition("/")[0]
            files[folder] = min(files.get(folder, (9,)), (*best, path))
    out = []
    for doc, path, _ in rows:
        folder, near = path.rpartition("/")[0], None
        while near is None:
            near = files.get(folder)
            if not folder:
                break
            folder = folder.rpartition("/")[0]
        best = own[doc]
        out.append((doc, path, best[1] if best else near[1] if near else None, round(-best[0], 6) if best else None, "own" if best else "inherited" if near else "none", path if best else near[2] if near else None))
    return sorted(out)


def got(df):
    return sorted((r.doc_id, r.path, r.license, None if r.cosine is None else round(r.cosine, 6), r.basis, r.source_path) for r in df.collect())


def test_whole_table(spark, small):
    docs = [(r.doc_id, f"{r.source}/{r.lang}/{r.doc_id}", r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    rows = got(queries.QUERIES["op8_license_scan"](spark, small))
    assert rows == brute(docs) and any(r[4] == "own" for r in rows)


FILES = [
    (1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/c/x.py", "print()"), (3, "a/b/LICENSE", "Licensed under the Apache License, Version 2.0.\n"),
    (4, "z.py", "code"), (5, "q/y.py", "This is a long text of other things here and there and more words.\nReleased under the MIT License."), (6, "q/w.py", ""),
    (7, "a/b/d.py", "the license is under a table in the licence office of the town"), (8, "a/r.txt", None), (9, "a/COPYING", "SPDX-License-Identifier: MIT"),
]


def test_nearest_ancestor(spark):
    rows = got(licenses.scan(spark.createDataFrame(FILES, "doc_id long, path string, text string")))
    assert rows == brute(FILES)
    by = {r[0]: r[2:] for r in rows}
    assert by[2][0] == "Apache-2.0" and by[2][2:] == ("inherited", "a/b/LICENSE") and by[4][2] == "none" and by[5][0] == "MIT" and by[6][2] == "none" and by[8][0] == "MIT"


def test_edges(spark, documents):
    docs = documents([None, "", "Released under the MIT License.", "Released under the MIT License.", "x"], ids=[1, 2, 3, 3, None], extra=True).withColumnRenamed("source", "path")
    rows = licenses.scan(docs).collect()
    assert sorted((str(r.doc_id), r.license, r.basis) for r in rows) == [("1", "MIT", "inherited"), ("2", "MIT", "inherited"), ("3", "MIT", "own"), ("None", "MIT", "inherited")]
    assert licenses.scan(documents([]).withColumnRenamed("source", "path")).count() == 0


TEXTS = {name: text for name, text in licenses.full_texts()}


def wrapped(text, width, mark=""):
    """Paragraphs wrapped anew, with a comment mark before every line."""
    return "\n".join(f"{mark}{line}" for p in re.split(r"\n\s*\n", text) for line in [*textwrap.wrap(" ".join(p.split()), width), ""])


def test_complete_licence_files(spark):
    """Every full text, wrapped anew, with a holder, is the licence file of its directory."""
    rows = []
    for k, (name, text) in enumerate(sorted(TEXTS.items())):
        for j, form in enumerate((wrapped(text, 79), wrapped(text, 10**9), wrapped(text, 60, "# "))):
            rows += [(100 * k + 10 * j, f"{name}/{j}/LICENSE", f"Copyright 2019 Some Holder\n\n{form}"), (100 * k + 10 * j + 1, f"{name}/{j}/src/x.py", "print()")]
    out = {r.path: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    for name in TEXTS:
        for j in range(3):
            assert out[f"{name}/{j}/LICENSE"].license == name and out[f"{name}/{j}/LICENSE"].basis == "own", (name, j)
            below = out[f"{name}/{j}/src/x.py"]
            assert (below.license, below.basis, below.source_path) == (name, "inherited", f"{name}/{j}/LICENSE")


def test_wrapped_headers(spark):
    """A header paragraph inside a longer file is found however it is wrapped, and the file is no licence file."""
    code = "\n\n" + "\n".join(f"value_{k} = compute(value_{k - 1}, {k})" for k in range(200))
    rows = [(k, f"d{k}/a.py", wrapped(text, 40, "// ") + code) for k, (_, text) in enumerate(licenses.HEADERS)] + [(50, "d0/b.py", "x")]
    out = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert [out[k].license for k in range(len(licenses.HEADERS))] == [name for name, _ in licenses.HEADERS] and out[50].basis == "none"


def test_gate_loses_nothing():
    """Any text with a cosine of 0.75 has the terms that the gate asks for: the heaviest part of each template decides."""
    for set_ in (licenses.HEADERS, licenses.full_texts()):
        known, fewest = licenses.gate(set_, 0.75)
        vectors = {}
        for k, _, t, w in licenses.template_table(set_, damped=True)[0]:
            vectors.setdefault(k, {})[t] = w
        assert fewest >= 1
        for v in vectors.values():
            rest = sorted((w * w for t, w in v.items() if t in set(known)), reverse=True)
            common = sum(w * w for t, w in v.items() if t not in set(known))
            assert math.sqrt(common + sum(rest[: fewest - 1])) < 0.75
