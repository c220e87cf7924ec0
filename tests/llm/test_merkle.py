"""Operator 1 against a plain Python tree."""

from __future__ import annotations

import hashlib
import re

from returnlens.llm import merkle as M

from .helpers import AWKWARD, docs_of


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def slow_tree(text: str):
    leaves = [[[sha("t" + s) for s in re.findall("[^.!?]+[.!?]*|[.!?]+", p)] for p in sec.split("\n")] for sec in text.split("\n\n")]
    paras = [[sha("p" + "".join(p)) for p in sec] for sec in leaves]
    sects = [sha("s" + "".join(s)) for s in paras]
    root = sha("d" + "".join(sects))
    return root, {h for s in leaves for p in s for h in p} | {h for s in paras for h in s} | {*sects, root}, paras


def near(a, b):
    return 2 * len(a & b) / (len(a) + len(b))


def expect(rows):
    """rows: (doc_id, text) in order."""
    out = []
    for i, (doc, text) in enumerate(rows):
        nxt = rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[:len(text) - half] + nxt[:half]
        (r, n, _), (er, en, _), (_, nn, _) = slow_tree(text), slow_tree(edited), slow_tree(nxt)
        out.append((doc, len(text), sha(edited), r, er, round(near(n, en), 12), round(near(n, nn), 12)))
    return out


def got(df):
    return [(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 12), round(r.near_next, 12))
            for r in df.collect()]


def test_awkward_texts(spark):
    texts = [*AWKWARD, "One. Two!\n\nThree? four\nfive.", "One. Two!\n\nThree? four\nfive.", "a.b.c" * 2000]
    rows = [(i, t or "") for i, t in enumerate(texts)]
    assert sorted(got(M.fingerprint_edits(docs_of(spark, texts)))) == sorted(expect(rows))


def test_uneven_ids_many_ranges(spark):
    rows = sorted({(i * i * i * 7 - 3000, f"text {i}. line {i % 5}\nmore") for i in range(900)})
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    assert sorted(got(M.fingerprint_edits(df))) == sorted(expect(rows))


def test_single_null_and_repeated_ids(spark):
    one = spark.createDataFrame([(4, "Some text. Here")], "doc_id bigint, text string")
    assert got(M.fingerprint_edits(one)) == expect([(4, "Some text. Here")])
    rows = [(1, "a a"), (1, "a a"), (2, "b b"), (None, "n n")]
    out = got(M.fingerprint_edits(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert sorted(out, key=str) == sorted(expect(rows), key=str)
    assert M.fingerprint_edits(docs_of(spark, [])).count() == 0


def test_edits_are_located(spark):
    df = spark.createDataFrame([("A.\nB.\n\nC.\nD.", "A.\nB.\n\nC.\nX.\nnew"), ("same", "same"), ("a", "a\n\nb")], "x string, y string")
    df = M.with_tree(M.with_tree(df, "x", "a"), "y", "b")
    out = [[tuple(e) for e in r.e] for r in df.select(M.edits("a", "b").alias("e")).collect()]
    assert out == [[(1, 1), (1, 2)], [], [(1, 0)]]


def test_plan_has_no_python_and_one_text_shuffle(spark):
    plan = M.fingerprint_edits(docs_of(spark, ["a", "b"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert plan.count("Exchange hashpartitioning") == 1
