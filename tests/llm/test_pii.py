import hashlib
import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from scholium.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def plain(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), rank, m.end(), kind))
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(out)]


CASES = [
    None, "", "a@b.c", "a@b.c_x@y.z", "é a.b+c@d-e.f.g! 1.2.3.4.5.6.7.8 300.1.1.1 0255.1.1.1", "4111 1111-1111 1111 and 4111111111111112", "+1 (337) 555-7349, +12345678 +1..........2345678",
    "+49 171 4111111111111111", "4111111111111111@x.org 10.0.0.1@h.co", "1.1.1.1@a.b", "a@b a@@b.c @b.c a@b..c", "00000000000000000000 000000000000", "x" * 5000 + "@" + "y." * 3000 + "z", "9" * 40000, "1 " * 20000, "1." * 20000, "a@b.c" * 2000,
]


def rand(rng):
    return "".join(rng.choice("0123456789.@ab +-_%()é") for _ in range(rng.randrange(60)))


def test_base_spans_are_the_definition(spark):
    rng = random.Random(7)
    texts = CASES + [rand(rng) for _ in range(1500)] + ["".join(rng.choice("0123456789. -") for _ in range(70)) for _ in range(500)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in pii.report(docs, "doc_id", "text").collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = plain(t)
        assert got[i].spans == ",".join(want), (t or "")[:200]
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        for k in BASE:
            assert got[i][f"n_{k}"] == sum(w.startswith(k) for w in want)


@pytest.fixture(scope="module")
def telling(spark):
    rows = [(i, f"Ask Zorblat in room {i} or write z@firm.org today\nnothing else here", i) for i in range(6)]
    rows += [(10 + i, f"today we ask in a room, or write of nothing {i}\nelse here", i) for i in range(60)]
    rows += [(100, "ZORBLAT was here; zorblatt was not.", 0), (101, "copy rare@x.org Quimby", 0), (102, "copy rare@x.org Quimby", 0), (103, "copy rare@x.org Quimby", 0), (104, None, 9), (None, "Zorblat", 0), (10, "repeat", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_chars int")


def test_disclosing_terms(telling):
    terms = {r.term: r for r in pii.disclosing(telling).collect()}
    assert set(terms) == {"zorblat"} and terms["zorblat"].removed
    got = {r.doc_id: r for r in pii.report(telling).collect()}
    assert got[100].spans == "" == got[None].spans  # neither holds what the word discloses
    assert got[0].spans.startswith("term:4:11,email:") and got[0].n_term == 1
    assert got[101].n_term == 0 and got[101].n_email == 1


def test_redaction(telling):
    rows = pii.redacted(telling)
    assert rows.columns == telling.columns
    got = {r.doc_id: r for r in rows.collect()}
    assert got[0].text == "Ask  in room 0 or write [EMAIL] today\nnothing else here"
    assert got[0].n_chars == len(got[0].text)
    assert got[100].text == "ZORBLAT was here; zorblatt was not." and got[101].text == "copy [EMAIL] Quimby"
    assert got[104].text is None and got[104].n_chars == 9
    assert rows.count() == telling.count() and pii.redacted(telling.limit(0)).count() == 0


def test_main_path_is_native(spark):
    plan = pii.op1_pii(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_query_matches_definition(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    for r in pii.op1_pii(spark, "/root/testdata/sf0.01").collect():
        assert [s for s in r.spans.split(",") if s and not s.startswith("term")] == plain(texts[r.doc_id])


def test_copied_contact_lines_disclose(spark):
    """A signature line that many documents share counts in each of them; short words and words with digits are terms too."""
    rows = [(i, f"text of its own {i}\nJo Quimby9 rare@x.org\nJo Quimby9 rare@x.org") for i in range(20)] + [(100 + i, f"other text {i}\nof its own") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.term: r.removed for r in pii.disclosing(docs).collect()} == {"jo": True, "quimby9": True}
    assert {r.doc_id: r.n_term for r in pii.report(docs).collect()} == {d: 4 if d < 100 else 0 for d, _ in rows}


def test_once_seen_entities_are_rated(spark):
    """A pair met once counts as soon as the corpus is so large that chance does not explain it."""
    docs = spark.range(1, 1_100_000).selectExpr("id AS doc_id", "'other line' AS text").union(spark.createDataFrame([(0, "other Quimby rare@x.org")], "doc_id long, text string"))
    assert {r.term: r.removed for r in pii.disclosing(docs).collect()} == {"quimby": True}
    assert pii.disclosing(docs.where("doc_id < 1000")).count() == 0
    assert pii.disclosing(docs.where("doc_id < 1000"), chance=0.01).first().term == "quimby"


def brute(rows, chance, remove=pii.REMOVE, generalise=pii.GENERALISE):
    """{(entity, term): removed} by the definition, over the different lines of each row."""
    lines = [line for text in rows for line in dict.fromkeys((text or "").split("\n"))]
    sets = []
    for line in lines:
        spans = plain(line)
        found = {f"{k}:{line[int(a):int(b)]}" for k, a, b in (s.split(":") for s in spans)}
        rest = line
        for e in sorted(found, key=lambda e: min(line.find(x) for x in [e.split(":", 1)[1]])):
            rest = rest.replace(e.split(":", 1)[1], " ")
        sets.append((found, set(re.findall(r"[^\W_]+", rest.lower()))))
    n = len(lines)
    out = {}
    for c in {c for found, _ in sets for c in found}:
        n_c = sum(c in found for found, _ in sets)
        for t in {t for found, words in sets if c in found for t in words}:
            n_t, n_ct = sum(t in words for _, words in sets), sum(c in found and t in words for found, words in sets)
            information, content = math.log2(n * n_ct / (n_c * n_t)), math.log2(n / n_c)
            p, q = n_ct / n_c, n_t / n
            kl = p * math.log(p / q) + ((1 - p) * math.log((1 - p) / (1 - q)) if p < 1 else 0)
            if information > 0 and n_c * kl >= -math.log(chance) and content > 0 and information / content >= generalise:
                out[c, t] = information / content >= remove
    return out


def test_terms_equal_brute_force(spark):
    rng = random.Random(11)
    mails = [f"m{i}@site{i % 3}.org" for i in range(12)]
    names = [f"name{i}" for i in range(40)]
    rows = []
    for i in range(250):
        lines = []
        for _ in range(rng.randrange(1, 5)):
            words = [f"w{rng.randrange(30)}" for _ in range(6)]
            if rng.random() < 0.25:
                k = rng.randrange(12)
                words += [mails[k], names[k] if rng.random() < 0.9 else names[rng.randrange(40)]]
                rng.shuffle(words)
            elif rng.random() < 0.1:
                words.append(names[rng.randrange(40)])
            lines.append(" ".join(words))
        rows.append("\n".join(lines))
    rows += ["org site1 " + rows[0], rows[1], rows[1], None]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    for chance in (1e-6, 1e-2):
        want = brute(rows, chance)
        assert {(r.entity, r.term): r.removed for r in pii.disclosing(docs, chance=chance).collect()} == want and want
    want = brute(rows, pii.CHANCE)
    for r in pii.report(docs).collect():
        text = rows[r.doc_id] or ""
        own = {f"{k}:{text[int(a):int(b)]}" for k, a, b in (s.split(":") for s in plain(text))}
        terms = {t for c, t in want if c in own}
        spans = [s.split(":") for s in r.spans.split(",") if s.startswith("term:")]
        assert sorted((int(a), int(b)) for _, a, b in spans) == sorted((m.start(), m.end()) for m in re.finditer(r"[^\W_]+", text) if m[0].lower() in terms)


@pytest.mark.parametrize("few", [True, False])
def test_words_cut_off_by_entities_are_counted(spark, monkeypatch, few):
    """What a card number leaves of a longer word may stand nowhere else but within entities."""
    monkeypatch.setattr(pii, "BROADCAST", 1000 if few else 0)
    rows = [(0, "5500005555555559fed\nplain words"), (1, "fed@mail.org\nmore of them"), (2, "so on\nand on")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.entity, r.term): (r.disclosure, r.removed) for r in pii.disclosing(docs, chance=1.0).collect()} == {("card:5500005555555559", "fed"): (1.0, True)}
    assert {r.doc_id: r.text for r in pii.redacted(docs).collect()} == {0: "[CARD]fed\nplain words", 1: "[EMAIL]\nmore of them", 2: "so on\nand on"}
    rows = ["5500005555555559fed by", "5500005555555559fed by", "fed@mail.org by", "ask by mail", *(f"line {i}" for i in range(20))]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    want = brute(rows, 0.1)
    assert {(r.entity, r.term): r.removed for r in pii.disclosing(docs, chance=0.1).collect()} == want and ("card:5500005555555559", "fed") in want


def test_clean_documents_are_left_alone(spark):
    """Rows without personal data get no span, though rows with it have terms."""
    rows = pii.op1_pii(spark, "/root/testdata/sf0.1")
    got = rows.selectExpr("n_email + n_ip + n_card + n_phone as n", "n_term", "spans").agg(F.expr("count_if(n = 0 and spans <> '')").alias("touched"), F.sum("n_term").alias("terms")).first()
    assert got.touched == 0 and got.terms > 0


def plainly_replaced(text):
    out, at = [], 0
    for _, start, stop in (s.split(":") for s in plain(text)):
        if int(start) >= at:
            out += [text[at : int(start)], "[X]"]
        at = max(at, int(stop))
    return "".join(out) + text[at:]


def test_spans_are_replaced_across_blocks(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["é" * rng.randrange(1, 3 * pii.CUT), " a@b.c ", "1.2.3.4", " +49 171 4111111111111111 ", "\n", "𝛼" * pii.CUT]) for _ in range(12)) for _ in range(40)]
    texts += ["a@b.c" + "x " * pii.CUT, "y" * (pii.CUT - 1) + " a@b.c", " " * pii.CUT + "a@b.c", "a@b.c", "x" * pii.CUT, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = pii.with_spans(docs, "text", "spans")
    for r in rows.select("doc_id", pii._replaced(F.col("text"), F.col("spans"), lambda s: F.lit("[X]")).alias("out")).collect():
        assert r.out == plainly_replaced(texts[r.doc_id])


def test_many_matches_in_one_text(spark):
    text = " ".join(f"u{i}@h{i % 977}.org" for i in range(50_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string").repartition(1)
    began = time.monotonic()
    got = pii.report(docs).first()
    assert got.n_email == 50_000 and got.base_sha256 == hashlib.sha256(",".join(plain(text)).encode()).hexdigest()
    assert pii.redacted(docs).first().text == " ".join(["[EMAIL]"] * 50_000)
    assert time.monotonic() - began < 60
