"""Small inputs with known results."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from docketlake.operators import chunking, cleaning, dialog, graph, knowledge, metrics, reasoning, timeline, vectors
from docketlake.functions.text import strip, word_count, words
from docketlake.sources import files, stores


def one(spark, text, step, **kw):
    return step(spark.createDataFrame([(text,)], "text string"), **kw).first().asDict()


def test_unicode(spark):
    r = one(spark, "“A” ‘b’ — x y​z ﬁn", cleaning.normalize_unicode)
    assert r["text"] == "\"A\" 'b' - x yz fin"


def test_whitespace(spark):
    r = one(spark, "  Word   with  too    many   spaces.  \n\n\n\nNew paragraph.  ", cleaning.cleanup_whitespace)
    assert r["text"] == "Word with too many spaces.\n\nNew paragraph."


def test_ocr(spark):
    r = one(spark, "a,, b:: c;; d\n.......\n_______\n| Title\nEnd |", cleaning.clean_ocr_artifacts)
    assert r["text"] == "a, b: c; d\nTitle\nEnd" and r["ocr_repairs"] == 7


def test_headers_and_footers(spark):
    page = "--- Page {n} ---\nSUPREME COURT\nCase 12 of 2020\nBody text number {n} is here.\nStrictly private\n"
    text = "".join(page.format(n=n) for n in (1, 2, 3))
    r = one(spark, text, cleaning.remove_repeating_headers)
    assert r["headers_removed"] == 6 and "SUPREME" not in r["text"] and "Body text number 2" in r["text"]
    r = one(spark, text, cleaning.remove_repeating_footers)
    assert r["footers_removed"] == 6 and "private" not in r["text"]


def test_headers_need_two_pages(spark):
    text = "--- Page 1 ---\nHEADER LINE\nx"
    assert one(spark, text, cleaning.remove_repeating_headers)["text"] == text


def test_page_numbers(spark):
    text = "--- Page 1 ---\nPage 1\nbody\nmore\nand more\nlast\n1 of 35\n--- Page 2 ---\nPg. 2\nbody\nmore\nand\nlast\n- 2 -"
    r = one(spark, text, cleaning.remove_page_numbers)
    assert r["page_numbers_removed"] == 4 and "1 of 35" not in r["text"] and "--- Page 2 ---" in r["text"]


def test_hyphenation(spark):
    r = one(spark, "The investi-\ngation of self-\nesteem.", cleaning.repair_hyphenation)
    assert r["text"] == "The investigation of self-esteem." and r["hyphen_repairs"] == 2


def test_line_wraps(spark):
    text = "This is a long\nsentence that was\nwrapped.\n- item one\n1. item two\nSECTION 5\nEnds with:\nkept"
    assert one(spark, text, cleaning.repair_line_wraps)["text"] == (
        "This is a long sentence that was wrapped.\n- item one\n1. item two\nSECTION 5 Ends with:\nkept")


def test_bullets(spark):
    r = one(spark, "- a\n  * b\n(a)    c\n1.  d", cleaning.normalize_bullets)
    assert r["text"] == "• a\n  • b\n(a) c\n1. d" and r["bullets_normalized"] == 4


def test_tables(spark):
    r = one(spark, "| Name | Age |\n|---|---|\n| John | 30 |\n| Mary | - |", cleaning.flatten_tables)
    assert r["tables_flattened"] == 1
    assert r["text"] == "--- Table Start ---\nRow 1:\n  Name: John\n  Age: 30\n\nRow 2:\n  Name: Mary\n  Age: —\n\n--- Table End ---"


def test_clean_documents(spark):
    text = ("--- Page 1 ---\nHIGH COURT BRIEF\nPage 1\nUnder Article 21 and Section 302 IPC the investi-\ngation was “fair”,, and\ncomplete.\n"
            "--- Page 2 ---\nHIGH COURT BRIEF\nPage 2\n- one item\nDone.")
    df = spark.createDataFrame([(1, text, "pdf"), (2, "", "txt")], "doc_id long, text string, category string")
    rows = {r.doc_id: r for r in cleaning.clean_documents(df).collect()}
    good = rows[1]
    assert "investigation" in good.cleaned and "Article 21" in good.cleaned and "HIGH COURT" not in good.cleaned
    assert good.report.citations_before == 2 and not good.report.warnings and good.report.version == "1.0.0" and len(good.report.history) == 10
    assert rows[2].reject_reason == "empty"
    ok, bad = cleaning.split_validated(cleaning.clean_documents(df))
    assert [r.doc_id for r in ok.collect()] == [1] and [r.doc_id for r in bad.collect()] == [2]


@pytest.mark.parametrize("original,cleaned,reason", [
    ("x" * 50, "", "empty"), ("some text", " ab ", "too_short"), ("x" * 200, "x" * 20, "text_loss"),
    ("aaaaaa\n\nb\n\nc\n\nd", "aaaaaa b c d", "paragraph_loss"), ("fine text", "fine text", None)])
def test_rejections(spark, original, cleaned, reason):
    df = spark.createDataFrame([(original, cleaned)], "text string, cleaned string")
    assert cleaning.validate_cleaned(df).first().reject_reason == reason


def chunks(spark, text, strategy, **lim):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return chunking.chunk_documents(df, strategy, limits=chunking.ChunkLimits(**lim)).orderBy("chunk_index").collect()


def test_paragraph_chunks(spark):
    out = chunks(spark, "First paragraph here.\n\nSecond paragraph here.\n\n" + "Third one. " * 20, "paragraph", max_chars=100)
    assert out[0].text == "First paragraph here.\n\nSecond paragraph here." and all(c.chars <= 100 for c in out)
    assert (out[0].paragraph_start, out[0].paragraph_end) == (1, 3)


def test_sliding_chunks_overlap(spark):
    out = chunks(spark, "One two three. Four five. Six seven eight. Nine ten.", "sliding", max_words=8, overlap_words=2)
    assert [c.text for c in out] == ["One two three. Four five. Six seven eight.", "Nine ten."]
    out = chunks(spark, "One two three. Four five six. Seven eight. Nine ten eleven.", "sliding", max_words=8, overlap_words=2)
    assert [c.text for c in out] == ["One two three. Four five six. Seven eight.", "Seven eight. Nine ten eleven."]


def test_heading_and_legal_chunks(spark):
    assert [c.section for c in chunks(spark, "Intro\n### FACTS\nIt happened.\nMAIN ISSUE\nWhy?", "heading")] == ["Introduction", "FACTS", "MAIN ISSUE"]
    out = chunks(spark, "--- Page 1 ---\nIntro.\n1. Facts of the case\nIt happened.\n--- Page 2 ---\nII. Prayer\nHelp.", "legal")
    assert [(c.section, c.page_start, c.page_end) for c in out] == [("Introductory Context", 1, 1), ("Facts", 1, 2), ("Relief", 2, 2)]


def test_chunk_checks(spark):
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    df = spark.createDataFrame([(1, 0, "tiny", 1, 1, 1, 1), (2, 0, "x" * 500, 1, 1, 1, 1)],
                               "doc_id long, chunk_index int, text string, page_start int, page_end int, paragraph_start int, paragraph_end int")
    got = {(r.doc_id, r.reason) for r in chunking.validate_chunks(df, docs, limits=chunking.ChunkLimits(max_chars=200)).collect()}
    assert got == {(1, "too_small"), (2, "too_large"), (3, "no_chunks")}


@pytest.mark.parametrize("raw,day", [("15/10/2023", "2023-10-15"), ("2023-11-20", "2023-11-20"), ("October 25, 2023", "2023-10-25"), ("31/02/2023", None), ("1.2.23", "2023-02-01")])
def test_dates(spark, raw, day):
    got = spark.createDataFrame([(raw,)], "d string").select(timeline.normalize_date("d")).first()[0]
    assert got == (None if day is None else dt.datetime.fromisoformat(day))


def test_legal_prose(spark):
    text = ("The plaintiff John Smith claimed a compensation of 5000 rupees for damages. Before Hon'ble Judge Amit Sharma at Delhi High Court. "
            "Section 302 of the IPC applies. The witness PW-1 Nitish Kumar was heard.")
    df = spark.createDataFrame([(1, 1, 1, text)], "case_id long, doc_id long, chunk_id long, text string")
    got = {(r.type, r.text) for r in knowledge.extract(df).collect()}
    assert ("party", "John Smith") in got and ("judge", "Amit Sharma") in got and ("court", "Delhi High Court") in got
    assert ("statute", "Indian Penal Code") in got and any(t == "witness" and n.startswith("Nitish Kumar") for t, n in got)
    assert any(t == "claim_primary" for t, _ in got)


def test_confidence(spark):
    df = spark.range(1).select(knowledge.combine_confidence(extractor=F.lit(0.9), strength=F.lit(0.5)).alias("a"),
                               knowledge.combine_confidence(extractor=F.lit(0.8), embedding=F.lit(None).cast("double")).alias("b"))
    r = df.first()
    assert (r.a, r.b) == (0.824, 0.8)


def test_ranking(spark):
    hits = spark.createDataFrame([("a", 0.85, "Summary Findings", 1), ("b", 0.90, "Final Conclusion Order", 2)], "id string, similarity double, section string, page_start int")
    got = {r.id: round(r.ranking_score, 3) for r in vectors.rank_chunks(hits).collect()}
    assert got == {"a": 0.9, "b": 0.94}


def test_context_budget(spark):
    rows = [(1, 7, "Deed", i, 1, "Facts", f"chunk {i} " + "word " * 30, i + 1) for i in range(2)] + [(1, 8, "Will", 4, 2, "Order", "other " * 30, 3)]
    hits = spark.createDataFrame(rows, "query_id long, doc_id long, title string, chunk_index int, page_start int, section string, text string, rank int")
    full = vectors.build_context(hits).first().context
    assert full.count("--- SOURCE DOCUMENT") == 2 and "chunk 0" in full and full.index("Deed") < full.index("Will")
    cut = vectors.build_context(hits, max_tokens=70).first().context
    assert cut.count("... [Truncated due to token limit]") == 1 and "Will" in cut  # the cut ends its document only


def test_followup(spark):
    turns = [(1, 0, "user", "Show the lease of Acme Holdings Ltd"), (1, 1, "assistant", "Here."), (1, 2, "user", "ok who signed it and when did they file?")]
    df = spark.createDataFrame(turns, "session_id long, turn long, role string, text string")
    got = {r.turn: r.rewritten for r in dialog.rewrite_query(df).collect()}
    assert got[2] == "who signed the lease and when did Show the lease of Acme Holdings Ltd file"  # the pattern takes all words before the ending


def test_responses(spark):
    rows = [("I am sorry.", True), ("See [Citation: c1]", True), ("See [Citation: c9]", False), ("word " * 31, False)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "answer_id long, content string")
    for retrieved in (spark.createDataFrame([("c1",)], "chunk_id string"), spark.createDataFrame([(1, "c1"), (0, "c9")], "answer_id long, chunk_id string")):
        checked = df.join(dialog.unknown_citations(df, retrieved), "answer_id", "left").orderBy("answer_id")
        assert [r[0].success for r in checked.select(dialog.validate_responses("content", "unknown")).collect()] == [ok for _, ok in rows]


def test_grounding(spark):
    df = spark.createDataFrame([(1, "Section 99 was used in 2019.", "only section 12", 1)], "answer_id long, answer string, context string, citations int")
    assert {r.type for r in reasoning.grounding_warnings(df).collect()} == {"hallucination", "factual_grounding"}
    assert reasoning.validate_answers(df).first().grounding_score == 0.7


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("plain é".encode("utf-8"))
    (tmp_path / "b.txt").write_bytes("wide é".encode("utf-16"))
    (tmp_path / "c.txt").write_bytes("old é".encode("latin-1"))
    got = {r.path[-5:]: (r.text.lstrip("﻿"), r.encoding, len(r.warnings)) for r in files.read_text_files(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": ("plain é", "utf-8", 0), "b.txt": ("wide é", "utf-16", 0), "c.txt": ("old é", "latin-1", 1)}


def test_export_and_snapshots(spark, tmp_path):
    m = spark.createDataFrame([("c", "s", "l", 1.0, "u")], "category string, section string, label string, value double, unit string")
    stores.export_metrics([m, m], str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2
    for at in ("2024-01-01 10:00:00", "2024-01-01 10:06:00"):
        stores.write_snapshot(m, str(tmp_path / "snap"), "cases", at)
    snaps = spark.read.parquet(str(tmp_path / "snap"))
    assert stores.newest_snapshot(snaps, "2024-01-01 10:08:00").first().computed_at == dt.datetime(2024, 1, 1, 10, 6)
    assert stores.newest_snapshot(snaps, "2024-01-01 11:00:00").count() == 0


def test_save_replacing(spark, tmp_path):
    path = str(tmp_path / "t")
    df = lambda rows: spark.createDataFrame(rows, "doc_id long, v string")
    stores.save_replacing(spark, df([(1, "a"), (1, "b"), (2, "c")]), path, ["doc_id"])
    stores.save_replacing(spark, df([(1, "new"), (3, "d")]), path, ["doc_id"])
    assert sorted((r.doc_id, r.v) for r in spark.read.parquet(path).collect()) == [(1, "new"), (2, "c"), (3, "d")]


def test_replacing_takes_the_keys_of_the_batch(spark, tmp_path):
    path = str(tmp_path / "t")
    df = lambda rows: spark.createDataFrame(rows, "doc_id long, v string")
    stores.save_replacing(spark, df([(1, "a"), (2, "b"), (3, "c")]), path, ["doc_id"], buckets=2)
    stores.save_replacing(spark, df([(2, "new")]), path, ["doc_id"], buckets=2, replaced=df([(1, None), (2, None)]))
    assert sorted((r.doc_id, r.v) for r in spark.read.parquet(path).collect()) == [(2, "new"), (3, "c")]
    stores.save_replacing(spark, df([]), path, ["doc_id"], buckets=2, replaced=df([(2, None), (3, None)]))
    assert spark.read.schema("doc_id long, v string").option("recursiveFileLookup", "true").parquet(path).count() == 0


def test_versions(spark, tmp_path):
    path, shape = str(tmp_path / "t"), "doc_id long, v string"
    df = lambda rows: spark.createDataFrame(rows, shape)
    now = lambda p=path: sorted(((r.doc_id, r.v) for r in stores.newest_rows(spark, p, ["doc_id"]).collect()), key=str)
    with pytest.raises(ValueError):
        now()
    assert stores.append_version(spark, df([(1, "a"), (1, "b"), (2, "c"), (None, "n")]), path, ["doc_id"]) == 1
    assert now() == [(1, "a"), (1, "b"), (2, "c"), (None, "n")]
    first = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("version=1/*")}
    stores.append_version(spark, df([(1, "new"), (3, "d"), (None, "m")]), path, ["doc_id"])
    assert now() == [(1, "new"), (2, "c"), (3, "d"), (None, "m")]
    stores.append_version(spark, df([]), path, ["doc_id"], replaced=df([(2, None), (9, None)]))
    assert now() == [(1, "new"), (3, "d"), (None, "m")]
    df([(1, "broken off"), (7, "x")]).write.parquet(f"{path}/rows/version=4")  # no keys: not finished
    assert now() == [(1, "new"), (3, "d"), (None, "m")]
    for _ in range(2):  # a batch that comes again
        stores.append_version(spark, df([(3, "last")]), path, ["doc_id"])
        assert now() == [(1, "new"), (3, "last"), (None, "m")]
    assert first == {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("version=1/*")}
    stores.compact_versions(spark, path, path + "2", ["doc_id"])
    assert now(path + "2") == now() and stores.newest_version(spark, path + "2") == 1
    with pytest.raises(ValueError):
        stores.compact_versions(spark, path, path + "2", ["doc_id"])


def test_long_path(spark):
    n = 66
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}", i) for i in range(n)], "src string, dst string, edge_id long").coalesce(1)
    assert graph.shortest_path(edges, "n0", f"n{n}").count() == 2 * n + 1
    assert graph.shortest_path(edges, "n0", f"n{n}", max_hops=4).count() == 0


def test_largest_documents_by_owner(spark):
    rows = [(i, f"f{i}", i % 2, "c", "text/plain", i * 1000, "processed") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, filename string, owner_id long, case_id string, mime_type string, file_size long, status string").withColumn("created_at", F.current_timestamp())
    found = metrics.document_metrics(docs, by=["owner_id"], largest=3).filter("section = 'largest_documents'")
    assert sorted((r.owner_id, r.label) for r in found.collect()) == [(0, "f14"), (0, "f16"), (0, "f18"), (1, "f15"), (1, "f17"), (1, "f19")]


def test_limits_are_named(spark):
    messages = spark.createDataFrame([(1, i, "user", f"question number {i} about a very long matter indeed", None) for i in range(1, 13)], "session_id long, turn long, role string, content string, citations_json string")
    whole, cut = (dialog.conversation_memory(messages, 5, *limits).first().summary for limits in ((), (3, 30)))
    assert whole.count("indeed") == 10 and cut.count("...") == 3
    cites = spark.createDataFrame([(1, 1, "same beginning " * 5 + "a", 0.9), (1, 2, "same beginning " * 5 + "b", 0.8)], "query_id long, id long, text string, score double")
    assert reasoning.rank_citations(cites).count() == 2 and reasoning.rank_citations(cites, 50).count() == 1


def test_tables_between_lines(spark):
    text = "before\n| a | b |\n|---|:-:|\n| 1 | |\n|\n x | y \n1|2|3\nafter\nlone | pipe"
    out = cleaning.flatten_tables(spark.createDataFrame([(text,), ("none",), (None,), ("|",)], "text string")).collect()
    assert out[0].text == ("before\n--- Table Start ---\nRow 1:\n  a: 1\n  b: —\n\n--- Table End ---\n|\n--- Table Start ---\nRow 1:\n  x: 1\n  y: 2\n  Column 3: 3\n\n--- Table End ---"
                           "\nafter\nlone | pipe")
    assert [(r.text, r.tables_flattened) for r in out[1:]] == [("none", 0), (None, 0), ("|", 0)] and out[0].tables_flattened == 2


def test_words_are_split_as_python_does(spark):
    texts = ["a\u00a0b c", "x\u3000y\u2003z", "caf\u00e9 \u0085 \u00fcber\tna\u00efve", "\u00f1o\u00f1o se\u00f1or\u2028d\u00eda", "", "  "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = df.select(word_count("text").alias("n"), words("text").alias("w"), strip("text").alias("s")).collect()
    assert [(r.n, r.w, r.s) for r in got] == [(len(t.split()), t.split(), t.strip()) for t in texts]
    chunks = {r.doc_id: r.words for r in chunking.chunk_sliding(df).collect()}
    assert all(chunks[i] == len(t.split()) for i, t in enumerate(texts) if i in chunks) and len(chunks) >= 1
