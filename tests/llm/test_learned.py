"""Problems 2, 3, 7 and 10: small fixtures with odd rows, held-out accuracy on the test tables, round trips."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pressloom.llm import furniture, learn, linewise, mojibake, pages, residue, truncation
from pressloom.llm.queries import QUERIES

# ---- learners -----------------------------------------------------------------------------------------------------


def test_boosted_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    m = learn.Boosted(trees=40).fit(x[:2000], y[:2000])
    assert ((m.logit(x[2000:]) > 0) == y[2000:]).mean() > 0.93


def test_decoding_drops_blocks_as_a_whole():
    got = furniture.decode(np.array([3.0, 2.0, -0.5, -4.0, -3.0, 1.0]), np.array([0, 0, 0, 1, 1, 1]))
    assert got.tolist() == [True, True, True, False, False, True]
    assert furniture.decode(np.zeros(0), np.zeros(0, int)).tolist() == []


# ---- 2, 3, 7: odd rows --------------------------------------------------------------------------------------------

WHO = ["Anna Orsa", "Bert Velt", "Cora Mirrow", "Dirk Tandis"]


def site(k):
    rng = random.Random(k)
    name = f"Source {k % 6}"
    sentence = lambda: f"{rng.choice(WHO)} said the {rng.choice(['small', 'new', 'old'])} {rng.choice(['library', 'bank', 'harbour'])} would {rng.choice(['open', 'close', 'move'])} before the {rng.choice(['summer', 'winter'])} in {rng.choice(WHO).split()[1]}."
    title = f"How {rng.choice(WHO).split()[1]} {rng.choice(['moved', 'closed'])} the {rng.choice(['small', 'old'])} bank number {k}"
    lines = ["Home | News | Contact", title, f"By {rng.choice(WHO)}", sentence(), "Share this story", sentence(), sentence(), f"© 2026 {name}. All rights reserved."]
    return [k, name, title, sentence(), "\n".join(lines), "kept"]


def items(spark):
    rows = [site(k) for k in range(240)]
    for k, text in {3: "404 Not Found\nThe requested URL /x was not found on this server.", 10: "Please enable JavaScript to continue.", 17: "{{ body }}", 24: "lorem ipsum dolor lorem ipsum lorem"}.items():
        rows[k][4] = text
    rows[31][4] = rows[31][4].replace("would", "{{ verb }}", 1)
    rows[38][4] += "\nReaders were shown “{{ headline }}” by Anna Orsa, who said the old bank would move before the summer in Velt."
    rows[45][4] = rows[45][4].rsplit("\n", 2)[0] + "\nAnna Orsa said the small library would open bef"
    rows[52][3] = "Bert Velt said the new harbour would close before […]"
    rows[59][3] = "chips, models, health, Orsa"
    rows += [[900, "Source 1", None, None, None, "kept"], [901, None, "", "", "", "kept"], [902, "Source 2", "t", " ", " \n ", "kept"], rows[3]]
    rows.append([903, "Source 2", "Long", "s", site(903)[4] + "\n" + "A long line said the old bank would move. " * 5000, "kept"])
    return spark.createDataFrame(rows, "item_id long, source string, title string, summary string, text string, line_no string")


def test_residue_furniture_and_cuts(spark):
    df = items(spark)
    bad = {r.item_id for r in residue.residue(df).collect()}
    assert {3, 10, 17, 24, 31} <= bad and len(bad) <= 6 and 38 not in bad
    got = {(r.item_id, r.line_no) for r in furniture.furniture(df).collect()}
    assert not any(i in bad for i, _ in got)
    good = [k for k in range(240) if k not in bad and k not in (38, 45)]
    hits = sum((k, n) in got for k in good for n in (1, 3, 5, 8)) / (4 * len(good))
    false = sum((k, n) in got for k in good for n in (2, 4, 6, 7)) / (4 * len(good))
    assert hits > 0.95 and false < 0.03
    cuts = {(r.item_id, r.field) for r in truncation.cut_values(df).collect()}
    assert {(45, "text"), (52, "summary")} <= cuts and (59, "summary") not in cuts and len(cuts) <= 4


def test_empty_tables(spark):
    none = items(spark).limit(0)
    assert residue.residue(none).count() == 0 and furniture.furniture(none).count() == 0 and truncation.cut_values(none).count() == 0
    assert mojibake.restored(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_held_out_sources(spark):
    data = "/root/testdata/sf0.01"
    import os

    if not os.path.exists(data):
        pytest.skip("no test tables here")
    for r in QUERIES["p2_validation"](spark, data).collect():
        assert r.n_residue >= 3 and r.missed <= 0.1 * r.n_residue + 1 and r.false_hits <= 0.01 * r.n_pages + 1


def test_the_ngrams_decide(spark):
    """Without n-grams, those of the line model and the page's own, residue is not told from short articles."""
    sampled, weights, model = pages.train_pages(items(spark))
    texts, titles = [r.text for r, _ in sampled], [r.title for r, _ in sampled]
    found = pages.residue_pages(texts, titles, weights, model)
    plain = np.zeros_like(weights)
    plain[-1] = weights[-1]
    model.w = np.zeros_like(model.w)
    assert found.sum() >= 4 and (pages.residue_pages(texts, titles, plain, model) != found).sum() >= 4


def test_lines_are_read_as_python_reads_them():
    rng = random.Random(9)
    texts = ["".join(rng.choice("ab B0.!’- \t\n\u2028é😀“|") for _ in range(rng.randint(0, 60))) for _ in range(200)] + [None, "", "x" * 3_000_000]
    got = [(page + lo, no, s) for lo, _, lines in linewise.in_chunks(texts) for page, no, s in zip(lines.page.tolist(), lines.no.tolist(), lines.strings(), strict=True)]
    assert got == [(i, n, s.strip()) for i, t in enumerate(texts) for n, s in enumerate((t or "").split("\n"), 1) if s.strip()]
    a, b = (linewise.Lines(["x\n" + t]).hashes().tolist() for t in ("On 25  May: Go", "on 7 MAY: go"))
    assert a == b and a[1] != linewise.Lines(["on 7 may go"]).hashes()[0]


def test_hidden_limits_are_found(spark):
    rng = random.Random(0)
    text = lambda n: "".join(rng.choice("abc &é\n") for _ in range(n))
    rows = []
    for k in range(60):
        rows.append((k, "bytes", "", text(rng.randint(100, 400)), ""))
        v = text(600)
        rows.append((100 + k, "bytes", "", v.encode()[:300].decode("utf-8", "ignore"), ""))
    df = spark.createDataFrame(rows, "item_id long, source string, title string, summary string, text string")
    weights = np.zeros((learn.DIM + 1, pages.KINDS), np.float32)
    vals = truncation.value_rows(df, weights, pages.PageModel().fit([], weights))
    got = {(r.m, r.length) for r in truncation.limits(vals).select(truncation.named(F.col("measure")).alias("m"), "length").collect()}
    assert ("utf8", 300) in got and not any(m == "html" for m, _ in got)


def test_lengths_under_other_representations():
    import html
    import json

    values = ["a<b> & \"q\" 'x'\n", "é€😀\t\\", "plain", "x […]", "\n"]
    got = truncation.lengths(values).tolist()
    for v, row in zip(values, got, strict=True):
        quoted = html.escape(v, quote=False)
        want = [len(v), len(v.encode()), len(v.encode("utf-16-le")) // 2, len(quoted), len(quoted) + 5 * (v.count('"') + v.count("'")), len(json.dumps(v, ensure_ascii=False)) - 2, len(json.dumps(v)) - 2, len(v.replace("\n", "\r\n"))]
        assert row[:8] == want
    assert got[3][8] == 1 and got[2][8] == 5


def test_limits_convict_and_acquit(spark):
    """Rows of the form of value_rows: without the limits' evidence the doubtful ones would all be judged alike."""
    lens = lambda n: [n] * len(truncation.MEASURES)
    rows = [(k, "A", "summary", lens(280), 1.0) for k in range(30)] + [(100, "A", "summary", lens(280), -2.0), (101, "A", "summary", lens(150), -2.0), (102, "A", "summary", lens(151), 0.3)]
    rows += [(200 + k, "B", "summary", lens(120), None) for k in range(30)] + [(300, "B", "summary", lens(120), 2.0), (301, "B", "summary", lens(90), 0.3), (302, None, "text", lens(70), 0.3)]
    vals = spark.createDataFrame(rows, truncation.VALUE)
    got = {r.item_id: r.odds + r.limit > 0 for r in truncation.judged(vals, truncation.limits(vals)).collect()}
    assert got[100] and not got[101]  # at the limit and elsewhere
    assert not got[102] and got[301] and got[302]  # a field with limits asks for more elsewhere
    assert not got[300]  # at a length where whole values gather
    without = {r.item_id for r in vals.filter("odds > 0").collect()}
    assert {i for i, c in got.items() if c} - without == {100} and without - {i for i, c in got.items() if c} == {102, 300}


def test_slots_in_quotation_marks_are_examples():
    assert pages.open_slots("shown “{{ headline }}” to") == 0 and pages.open_slots("the {{ headline }} and %(x)s and [[Y]]") == 3
    assert pages.open_slots("costs $5 and {braces} 100%") == 1 and pages.open_slots("") == 0


# ---- 10 -----------------------------------------------------------------------------------------------------------

CLEAN = [
    "„Für die Förderung wäre das zu früh“, sagte Anna von Köln. Größere Änderungen fürchtet niemand.",
    "Le coût, estimé à 9 millions d’euros, a cédé à l’été. « Ce n’est pas déjà gagné », a déclaré l’hôpital.",
    "La compañía publicó jamás el año pasado. ¿Podrá la región sostener «el plazo» según el acta?",
    "“We never promised a bank,” it said — not at €3 a month, and the company’s café isn’t naïve.",
    "NÃO É SÓ isso: a conclusão é que a região não saiu do papel, disse o ministério.",
    "Plain words only.",
]
CHANNELS = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("utf-8", "cp850"), ("utf-8", "cp1251"), ("cp1252", "mac_roman")]


def wrong(text, written, read):
    return "".join(mojibake._decoder(read).get(b) or chr(b) if b >= 128 else chr(b) for b in text.encode(written))


@pytest.fixture(scope="module")
def documents():
    rng = random.Random(1)
    docs = ["\n\n".join(rng.choice(CLEAN) for _ in range(4)) for _ in range(600)]
    rows, want = [(k, d) for k, d in enumerate(docs)], {}
    for k, (written, read) in enumerate(CHANNELS * 3):
        doc = "\n\n".join(CLEAN[:5]) if written == "utf-8" else "\n\n".join(CLEAN[:2] + CLEAN[2:5])
        lines = doc.split("\n\n")
        if k >= 7:
            lines[0] = lines[0]
        bad = "\n\n".join(wrong(x, written, read) if k < 14 or i % 2 else x for i, x in enumerate(lines))
        rows.append((1000 + k, bad))
        want[1000 + k] = doc
    twice = wrong(wrong(CLEAN[1], "utf-8", "cp1252"), "utf-8", "cp1252")
    rows += [(2000, twice), (2001, wrong(CLEAN[1], "utf-8", "cp1252").replace("\xa0", " ")), (2002, CLEAN[1].encode("cp1252").decode("utf-8", "replace"))]
    want |= {2000: CLEAN[1], 2001: CLEAN[1], 2002: None}
    rows += [(3000, CLEAN[3] + " The feed printed “Ã©” where an accent belonged."), (3001, None), (3002, ""), (3003, CLEAN[1].replace(" ", "\xa0", 3))]
    return rows, want


def test_round_trips(spark, documents):
    rows, want = documents
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("restored", learn_lit("x")).drop("restored")
    got = {r.doc_id: r.restored for r in mojibake.restored(df).collect()}
    assert set(got) == set(want)
    assert {k for k in want if got[k] != want[k]} == set()


@pytest.mark.parametrize("read", ["cp1251", "koi8-r", "cp1252", "iso8859-2"])
def test_garbling_of_a_third_of_the_documents(spark, read):
    docs = ["\n\n".join(random.Random(k).choice(CLEAN[:5]) + f" {k}" for k in range(i, i + 4)) for i in range(300)]
    rows = [(k, wrong(d, "utf-8", read) if k % 3 == 0 else d) for k, d in enumerate(docs)]
    got = {r.doc_id: r.restored for r in mojibake.restored(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {k for k in range(300) if k % 3 == 0}
    assert all(got[k] == docs[k] for k in got)


def test_spans_beside_sound_letters_are_restored(spark):
    """Lines that hold sound accented letters and a damaged span, and a lost byte told by the frequency of words."""
    docs = ["\n\n".join(random.Random(k * 7 + j).choice(CLEAN[:5]) for j in range(4)) for k in range(300)]
    mixed = CLEAN[1].replace("été", wrong("été", "utf-8", "cp1252"))
    assert "à" in mixed and mixed != CLEAN[1]
    lost = wrong("Á Álava", "utf-8", "cp1252").replace("\x81", "\ufffd")
    rows = [*enumerate(docs), (900, mixed), (901, lost), (902, "CAFÉ”, dit-il, à l’étranger. " + CLEAN[1])]
    rows += [(1000 + k, "Álava queda en Álava.") for k in range(20)]
    got = {r.doc_id: r.restored for r in mojibake.restored(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {900: CLEAN[1], 901: "Á Álava"}


def test_many_lost_bytes_are_searched_whole():
    model = mojibake.Model(10, {"S😀S": 5, "SéS": 3}, {})
    any_byte = tuple(range(0x80, 0xC0))
    assert mojibake._utf8([(0xF0,), any_byte, any_byte, any_byte], model, "S", "S") == ["😀"]
    assert mojibake._utf8([(0xC3,), (0xA9,)] * 3, model, "S", "S") == ["ééé"]


def learn_lit(x):
    from pyspark.sql import functions as F

    return F.lit(x)


def test_reports_agree_with_what_is_found(spark, data):
    q = lambda name: QUERIES[name](spark, data).collect()
    raw = {r.item_id: r for r in spark.read.parquet(f"{data}/items.parquet").select("item_id", "text", "summary").collect()}
    bad = {r.item_id for r in q("p2_found")}
    assert bad and {r.item_id for r in q("p2_clean")} == set(raw) - bad
    lines = {(r.item_id, r.line_no) for r in q("p3_found")}
    assert lines and not bad & {i for i, _ in lines}
    for r in q("p3_clean"):
        want = [s for n, s in enumerate((raw[r.item_id].text or "").split("\n"), 1) if (r.item_id, n) not in lines]
        assert r.text == (raw[r.item_id].text and "\n".join(want))
    cuts, sources = {(r.item_id, r.field) for r in q("p7_found")}, q("p7_sources")
    assert cuts and sum(r.n_cut for r in sources) == len(cuts) and all(0 <= r.n_by_limit <= r.n_cut <= r.n_values for r in sources)
    assert sum(r.n_values for r in sources) == sum(bool(t and t.strip()) for r in raw.values() for t in (r.text, r.summary))
    assert all(r.n >= truncation.LEAST and r.n_open <= r.n for r in q("p7_limits"))
    garbled, report = q("p10_found"), q("p10_report")
    assert garbled and sum(r.n_garbled for r in report) == len(garbled) and sum(r.n_lost for r in report) == sum(r.restored_md5 == "lost" for r in garbled)
