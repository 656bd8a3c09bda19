import random
import time

import pytest

from scholium.operators import corpus, lexicon
from scholium.operators import search_index
from scholium.operators.search_index import SearchIndex, trigrams

DIR = "/root/testdata/sf0.01"


def words(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdeé 日") for _ in range(rng.randrange(1, 9))) for _ in range(n)]


@pytest.mark.parametrize("most", [1 << 25, 3000])
def test_terms_are_those_contained(spark, most):
    terms = words(900, 1) + ["", None, "a", "a", "aa", "aab"]
    texts = [(i, " ".join(words(12, i))) for i in range(120)] + [(500, None), (501, ""), (1, "again aab")]
    got = lexicon.matches(spark.createDataFrame(texts, "paper_id long, text string").repartition(3), spark.createDataFrame([(t,) for t in terms], "term string"), most=most).collect()
    plain = lambda t: sorted({w for w in terms if w and w in (t or "")})
    assert sorted((r.paper_id, r.terms) for r in got) == sorted((i, plain(t)) for i, t in texts)


def test_many_terms_and_time_by_their_number(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").selectExpr("doc_id as paper_id", "lower(text) as text").cache()
    texts = {r.paper_id: r.text for r in docs.collect()}
    rng = random.Random(2)
    whole = " ".join(texts.values())
    some = [whole[i : i + rng.randrange(9, 16)] for i in (rng.randrange(len(whole) - 20) for _ in range(500))] + [f"{rng.random()}" for _ in range(49_500)]
    took = {}
    for n in (500, 50_000):
        terms = spark.createDataFrame([(t,) for t in some[:n]], "term string")
        lexicon.matches(docs, terms).count()
        began = time.time()
        got = {r.paper_id: r.terms for r in lexicon.matches(docs, terms).collect()}
        took[n] = time.time() - began
    assert got == {i: sorted({s for s in some[:500] if s in t}) for i, t in texts.items()}
    assert took[50_000] < 4 * took[500] + 3
    assert lexicon.matches(docs.limit(0), terms).count() == 0 and all(not r.terms for r in lexicon.matches(docs.limit(3), terms.limit(0)).collect())


def read_rows(frame):
    """Rows that the scans of an executed plan gave out."""
    frame.collect()
    found, todo = 0, [frame._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if "AdaptiveSparkPlan" in node.nodeName():
            todo.append(node.executedPlan())
            continue
        if "Scan" in node.nodeName():
            found += node.metrics().apply("numOutputRows").value()
        kids = node.children()
        todo += [kids.apply(i) for i in range(kids.size())]
        if "QueryStage" in node.nodeName():
            todo.append(node.plan())
    return found


def test_index_equals_the_scan_and_reads_less(spark, tmp_path):
    papers = spark.read.parquet(f"{DIR}/documents.parquet").selectExpr("concat('p', doc_id) as paper_id", "case when doc_id % 50 = 0 then null else text end as abstract")
    index = SearchIndex(spark, f"file://{tmp_path}/i").build(papers)
    texts = [r.abstract for r in papers.where("abstract is not null").collect()]
    rng = random.Random(4)
    asked = ["", "TH", "the", "none of this is there at all, surely"]
    for n in (2, 3, 7, 20, 50):
        text = rng.choice([t for t in texts if len(t) > 60])
        at = rng.randrange(len(text) - n)
        asked.append(text[at : at + n].upper() if n % 2 else text[at : at + n])
    for query in asked:
        want = {r.paper_id for r in corpus.search(papers, query, "abstract").select("paper_id").collect()}
        assert {r.paper_id for r in index.search(query).collect()} == want, query
    rare = next(q for q in (t[50:90] for t in texts if len(t) > 200) if sum(q.lower() in t.lower() for t in texts) == 1)
    assert read_rows(index.search(rare)) < read_rows(index.search("")) / 2
    assert "EqualTo(block," in index.search(rare)._jdf.queryExecution().executedPlan().toString()


def test_index_of_lists_and_of_nothing(spark, tmp_path):
    rows = spark.createDataFrame([("a", ["Ann Lee", "Bo"]), ("b", None), ("c", [])], "paper_id string, authors array<string>")
    index = SearchIndex(spark, f"file://{tmp_path}/i").build(rows, "authors")
    assert [r.paper_id for r in index.search("lee, b").collect()] == ["a"] and index.search("").count() == 2
    assert SearchIndex(spark, f"file://{tmp_path}/j").build(rows.limit(0), "authors").search("abc").count() == 0
    assert trigrams("abcab") == ["abc", "bca", "cab"] and trigrams("ab") == []


def test_postings_are_the_trigrams_of_each_block_once():
    import pyarrow as pa

    texts = [(3, "ab"), (3, ""), (3, "cde"), (3, "cdef\U0001f600é\n"), (5, "ef"), (5, "g"), (5, "abcabcabc"), (9, ""), (9, "xyz"), (11, "")]
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string())], ["block", "text"])
    for pieces in ([texts], [texts[:3], texts[3:6], [], texts[6:]]):
        got = [r for b in search_index._postings(map(batch, pieces)) for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        spelt = [("".join(chr(g >> k & 0x1FFFFF) for k in (0, 21, 42)), block) for g, block in got]
        assert len(spelt) == len(set(spelt)) and set(spelt) == {(g, b) for b, t in texts for g in trigrams(t)}
